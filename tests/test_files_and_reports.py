"""Dictionary files, program reports, category lookup and vertical lists."""

import json

from shelfsight.operators import content as ct
from shelfsight.operators import market as mk
from shelfsight.sources import feeds


def test_dictionary_files_keep_file_order_and_set_broken_parts_aside(spark, tmp_path):
    def entry(n, **more):
        return {"latinName": f"n{n}", "commonNames": [f"c{n}"], "usageCount": n} | more
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.json").write_text(json.dumps([entry(3), "text", None, {"usageCount": "many"}, {"latinName": " "}, entry(4, synonyms=["s"])], indent=1))
    (tmp_path / "a.json").write_text(json.dumps([entry(1), entry(2), entry(1)]))
    (tmp_path / "c.json").write_text('[{"latinName": "cut')
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "sub" / "e.json").write_text(json.dumps([entry(5, extra={"x": [1]})]))
    read = feeds.dictionary_files(spark, str(tmp_path))
    got = feeds.dictionary_entries(read).orderBy("entry_pos").collect()
    assert [(r.entry_pos, r.latin, r.usage_count) for r in got] == [(1, "n1", 1), (2, "n2", 2), (3, "n1", 1), (4, "n3", 3), (5, "n4", 4), (6, "n5", 5)]
    assert got[4].synonyms == ["s"] and got[0].synonyms == []
    bad = feeds.dictionary_rejects(read).collect()
    assert sorted(r.place for r in bad if r.place is not None) == [1, 2, 3, 4]
    assert [r.file.rsplit("/", 1)[1] for r in bad if r.place is None] == ["c.json"]


def test_empty_dictionary_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    read = feeds.dictionary_files(spark, str(tmp_path))
    assert feeds.dictionary_entries(read).count() == feeds.dictionary_rejects(read).count() == 0


def test_presets_and_report_without_programs(spark):
    none = spark.createDataFrame([], "program_id long, name string, country string, relevance long, category_flags map<string,boolean>")
    rows = {r.preset: r for r in mk.preset_stats(none).collect()}
    assert set(rows) == {"aggressive-cost-saving", "balanced", "quality-first"}
    assert all(r.processed == r.ai_calls == 0 and r.ai_percentage == 0 for r in rows.values())
    assert mk.coverage_text(none, ["plants"]).head()[0] == "No programs discovered."


def test_preset_thresholds_and_missing_relevance(spark):
    d = spark.createDataFrame([(x,) for x in (90, 80, 75, 30, 20, 10, None)], "relevance long")
    got = {r.preset: (r.processed, r.keyword_only, r.ai_calls) for r in mk.preset_stats(d).collect()}
    assert got["aggressive-cost-saving"] == (7, 6, 1)
    assert got["balanced"] == (7, 4, 3)
    assert got["quality-first"] == (7, 2, 5)


def test_top_programs_ties_and_unknown_place(spark):
    d = spark.createDataFrame([(2, "b", None, 90), (1, "a", "Wales", 90), (3, "c", "USA", 95)], "program_id long, name string, country string, relevance long")
    assert [r.line for r in mk.top_programs(d, 3).orderBy("rank").collect()] == [
        "1. c (95/100) - USA", "2. a (90/100) - Wales", "3. b (90/100) - Location unknown"]


def test_categories_are_found_by_key_name_and_id(spark):
    known = spark.createDataFrame([("7", "garden-tools", "Garden Tools"), ("9", "seeds", "All seeds")], "category string, key string, name string")
    wanted = spark.createDataFrame([(x,) for x in ("GARDEN  tools", "all SEEDS", "9", "seeds", "seeds", "none", None)], "wanted string")
    edges = spark.createDataFrame([("7", "9", 12.0, "unrelated")], "source string, target string, score double, relation string")
    got = {r.wanted: (r.source, r.target) for r in mk.category_affinity(wanted, known, edges).collect()}
    assert got == {"GARDEN  tools": ("7", "9"), "all SEEDS": ("9", None), "9": ("9", None), "seeds": ("9", None), "none": (None, None), None: (None, None)}


def test_vertical_terms_follow_category_order_and_keep_repeats(spark):
    rows = [("v", "brand", 2, 1, "x"), ("v", "brand", 1, 2, "y"), ("v", "brand", 1, 1, "z"), ("v", "brand", 3, 1, "x"), ("v", "keyword", 1, 1, "k")]
    d = spark.createDataFrame(rows, "vertical string, kind string, cat_pos int, pos int, term string")
    got = ct.vertical_terms(d).where("kind = 'brand'").orderBy("n").collect()
    assert [(r.n, r.term) for r in got] == [(1, "z"), (2, "y"), (3, "x"), (4, "x")]
