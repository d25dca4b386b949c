"""The pipeline's stages on planted cases."""
import corpus_pipeline as cp
from concord.llm.common import saved
from concord.session import read_table

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    import random
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["an", "ther", "in", "ou", "st", "le", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)) + "."


def test_stages_catch_planted_cases_and_keep_clean_documents(spark):
    docs = read_table(spark, SF, "documents").cache()
    bench = read_table(spark, SF, "benchmark").orderBy("item_id").first().text
    shared = prose(1, 70)
    base = prose(2, 300)
    near = base.replace(base.split()[150], "changedword", 1)
    planted = [(900001, prose(3, 200), "en"), (900002, base, "en"), (900003, base, "en"), (900004, near, "en"), (900005, "12345 !!! ???", "en"), (900006, None, "en"),
               (900007, f"{prose(4, 80)} {shared} {prose(5, 80)}", "en"), (900008, f"{prose(6, 90)} {shared} {prose(7, 60)}", "en"), (900009, f"{prose(8, 60)} {bench} {prose(9, 60)}", "en")]
    rows = spark.createDataFrame([(d, t, lang, "planted", None if t is None else len(t)) for d, t, lang in planted], docs.schema)
    now = docs.unionByName(rows)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = now
        now = saved(stage(spark, now, SF), f"test-{name}")
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r for r in now.where("doc_id >= 900000").collect()}
        assert now.count() <= before.count()
    assert set(kept["language_id"]) == {900001, 900002, 900003, 900004, 900007, 900008, 900009}
    assert 900002 in kept["simhash_dedup"] and 900003 not in kept["simhash_dedup"]
    assert {900001, 900007, 900008, 900009} <= set(kept["simhash_dedup"])
    cut = kept["suffix_dedup"]
    assert shared in cut[900007].text and shared[60:-60] not in cut[900008].text and cut[900008].n_chars == len(cut[900008].text)
    assert set(kept["decontaminate"]) == set(cut) - {900009}
    packed = cp.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    t = prose(11, 120)
    rows = [(5, t), (5, t), (4, t), (None, t), (None, "only null"), (None, "only null"), (7, "seven words of a quite different text"), (7, "seven words of a quite different text"), (8, None), (9, "")]
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in rows], docs.schema)
    got = sorted((str(r.doc_id), r.text) for r in cp.simhash_dedup(spark, df, SF).collect())
    assert got == sorted([("4", t), ("None", "only null"), ("7", "seven words of a quite different text"), ("8", None)], key=lambda r: (r[0], str(r[1])))


def test_run_gives_the_packed_rows(spark):
    out = cp.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_stages_of_an_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
