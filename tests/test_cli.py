import json

from quarry.__main__ import main


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_jobs_end_to_end(spark, tmp_path):
    reviews = [{"review_id": str(i), "user_id": f"u{i % 4}", "business_id": f"b{i % 3}", "stars": float(1 + i % 5), "text": f"good food {i % 3}", "date": "2020-01-01 00:00:00"} for i in range(24)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, reviews)))
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"business_id": f"b{i}", "categories": "Food, Bar", "state": "NV"}) for i in range(3)))
    (tmp_path / "t.json").write_text(json.dumps({"user_id": "u1", "business_id": "b2"}))
    (tmp_path / "s.txt").write_text("the\n")
    p = lambda n: str(tmp_path / n)
    main(["review-stats", p("r.json"), p("stats"), p("s.txt"), "2020", "2", "2"])
    assert json.loads(lines(tmp_path / "stats")[0])["A"] == 24
    main(["category-averages", p("r.json"), p("b.json"), p("cats"), "2"])
    assert [x["category"] for x in json.loads(lines(tmp_path / "cats")[0])["result"]] == ["Bar", "Food"]
    main(["partitions", p("r.json"), p("parts"), "custom", "3", "2"])
    assert sum(json.loads(x)["n_items"] for x in lines(tmp_path / "parts/partitions")) == 24
    main(["preprocess", p("r.json"), p("b.json"), "NV", p("csv")])
    main(["item-sets", "1", "3", p("csv"), p("sets")])
    assert lines(tmp_path / "sets")[-1].startswith("('b0', 'b1', 'b2')")
    main(["similar-businesses", p("r.json"), p("sim")])
    assert len(lines(tmp_path / "sim")) == 3
    main(["content-train", p("r.json"), p("model"), p("s.txt")])
    main(["content-predict", p("model"), p("t.json"), p("match")])
    for kind in ("item", "user"):
        main(["cf-train", p("r.json"), p(f"cf-{kind}"), kind])
        main(["cf-predict", p("r.json"), p("t.json"), p(f"cf-{kind}"), p(f"out-{kind}"), kind])
        assert len(lines(tmp_path / f"out-{kind}")) <= 1
