"""Schemas of the inputs, and the list of what a table's columns mean."""

from __future__ import annotations

REVIEW = "review_id string, user_id string, business_id string, stars double, text string, date string"
BUSINESS = "business_id string, categories string, state string"
TEST_PAIR = "user_id string, business_id string"
ITEM_MODEL = "b1 string, b2 string, sim double"
USER_MODEL = "u1 string, u2 string, sim double"
USER_BUSINESS = "user_id string, business_id string"
