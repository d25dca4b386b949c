"""Operators 1 and 3 against brute force."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from concord.llm import chat, decontaminate
from concord.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(ws, k=5):
    return [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)] or ([tuple(ws)] if ws else [])


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        ws = words(t)
        for i, it in items:
            iw = words(it)
            for p in range(len(ws) - len(iw) + 1 if iw else 0):
                s = similarity(grams(ws[p:p + len(iw)]), grams(iw))
                if s >= least and s > out.get((d, i), (0,))[0] + 1e-12:
                    out[d, i] = (s, p, len(iw))
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-12


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"


@pytest.fixture(scope="module")
def items():
    return [(1, ITEM), (2, "short one"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (6, ITEM), (None, "null item with some seven words inside"), (7, "The, THE the!")]


def test_copies_and_changes(spark, docs_of, items):
    ws = ITEM.split()
    changed = " ".join(["changed", *ws[1:]])
    docs = [(1, f"before {ITEM.upper()} after, " + "filler " * 50), (2, f"x {changed} y"), (3, " ".join(ws[::2])), (4, "a short, ONE\nhere"), (5, None), (6, ""),
            (7, "the " * 40), (None, f"null {ITEM}"), (8, "null item with some seven words inside"), (9, f"{ITEM} {ITEM}"), (9, f"{ITEM} {ITEM}"), (9, "other text"),
            (10, " ".join(ws[:12] + ["new", "words"] + ws[14:])), (11, "word " * 20000 + ITEM)]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    same(found(decontaminate.find_leaks(docs_of(docs), bench)), brute(docs, items))
    kept = decontaminate.clean(docs_of(docs), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if not any(k[0] == d for k in brute(docs, items)))
    assert kept.columns == docs_of(docs).columns


def test_windows_at_the_edges_short_texts_and_moved_parts(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(50))
    ws = long.split()
    other = [f"other{i}" for i in range(60)]
    docs = [(1, " ".join(ws[1:] + other)), (2, " ".join(other + ws[:-1])), (3, " ".join(ws[25:] + ws[:25])), (4, " ".join(other[:7] + ws[26:] + ws[:26] + other[7:])),
            (5, " ".join(ws[2:] + other)), (6, " ".join(ws[:20] + other)), (7, " ".join(ws[:24] + ["x"] + ws[24:] + other))]
    bench = spark.createDataFrame([(1, long)], "item_id bigint, text string")
    want = brute(docs, [(1, long)])
    assert {d for d, _ in want} == {1, 2, 3, 4, 5, 7}
    cut = [(11, " ".join(ws[1:])), (12, " ".join(ws[:-1])), (13, " ".join(ws[:30])), (14, " ".join(ws[:24] + ws[25:])), (15, "w1 w2")]
    for d, t in cut:                  # shorter than the item: the whole text is the window
        s = similarity(grams(words(t)), grams(ws))
        if s >= 0.8:
            want[d, 1] = (s, 0, len(words(t)))
    assert {d for d, _ in want} == {1, 2, 3, 4, 5, 7, 11, 12, 14}
    same(found(decontaminate.find_leaks(docs_of(docs + cut), bench)), want)


def test_clean_tells_rows_without_an_id_apart(spark, docs_of):
    docs = [(None, f"null {ITEM}"), (None, "a clean text"), (None, None), (1, f"x {ITEM}"), (2, "another clean text")]
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = {(r.doc_id, r.text) for r in decontaminate.clean(docs_of(docs), bench).collect()}
    assert kept == {(None, "a clean text"), (None, None), (2, "another clean text")}


def test_odd_and_empty_tables(spark, docs_of, odd_rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    same(found(decontaminate.find_leaks(docs_of(odd_rows), bench)), brute(odd_rows, items))
    assert decontaminate.find_leaks(docs_of([]), bench).count() == 0
    assert decontaminate.find_leaks(docs_of(odd_rows), bench.limit(0)).count() == 0


def test_shuffled_joins_give_the_same(spark, docs_of, items, monkeypatch):
    docs = [(1, f"before {ITEM}"), (2, "nothing at all here"), (3, f"{ITEM} and {ITEM}")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    same(found(decontaminate.find_leaks(docs_of(docs), bench)), brute(docs, items))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    shared = {g for _, t in items for g in grams(words(t))}
    near = [(d, t) for d, t in docs if any(g in shared for g in grams(words(t)))]      # the rest cannot match
    same(found(QUERIES["op1_decontamination"](spark, SF)), brute(near, items))


def test_blocks_guarantee_the_radius(spark):
    import random

    rnd = random.Random(1)
    flips = decontaminate.RADIUS // decontaminate.BLOCKS
    rows = []
    for i in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "i int, a bigint, b bigint")
    left = df.select("i", F.explode(decontaminate.block_keys(F.col("a"), decontaminate.BLOCKS, flips)).alias("k"))
    right = df.select("i", F.explode(decontaminate.block_keys(F.col("b"), decontaminate.BLOCKS, 0)).alias("k"))
    assert left.join(right, ["i", "k"]).select("i").distinct().count() == 200


# --- chat ----------------------------------------------------------------

def test_chat_round_trip(spark):
    texts = ["", None, "\\", "<|", "<\\|", "\\<|end|>\n", "<|turn|>assistant<|text|>x", "a\\n<\\\\|b", "é🙂\n\n", "<", "|", "<|end|>\n<|end|>\n", r"\### Assistant: </turn> ok"]
    roles = ["user", "assistant", None, "sys|tem<|", "assistant"]
    rows, n = [], 0
    for c in range(6):
        for t in range(len(texts)):
            rows.append((None if c == 5 else c, t // 2, roles[n % 5], texts[(t + c) % len(texts)], "clash"))
            n += 1
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(3)
    out = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = out.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r or "", (x or "").replace("\\", "\\\\").replace("<|", "<\\|"), x or ""))
    assert len(got) == len(by)
    for r in got:
        want = sorted(by[r.conv_id])
        assert [(x.role, x.text) for x in r.t] == [(w[1], w[3]) for w in want]
        assert r.loss == "".join(w[3] for w in want if w[1] == "assistant")
        assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == [w[2] for w in want if w[1] == "assistant"]
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_parts_become_ordered_placeholders(spark):
    part = "array<struct<type:string,text:string,ref:string,units:double>>"
    rows = [(1, 0, "user", [("text", "see <|image|> ", None, None), ("image", None, "i.png", None), ("audio", None, "a.wav", 2.5)]),
            (1, 1, "assistant", [("document", None, "d.pdf", 3.0), ("text", "ok", None, None), ("odd", "kept", None, None)]), (2, 0, "user", None), (2, 1, "assistant", [])]
    r = {x.conv_id: x for x in chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts {part}")).collect()}
    assert r[1].formatted == "<|turn|>user<|text|>see <\\|image|> <|image|><|audio|><|end|>\n<|turn|>assistant<|text|><|document|>okkept<|end|>\n"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in r[1].attachments] == [(1, "image", "i.png", 576), (1, "audio", "a.wav", 63), (2, "document", "d.pdf", 2304)]
    assert r[1].expanded_tokens == 576 + 63 + 2304 and r[2].expanded_tokens == 0
    assert r[2].formatted == "<|turn|>user<|text|><|end|>\n<|turn|>assistant<|text|><|end|>\n"


def test_chat_query_against_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(ORACLES["op3_chat_formatting"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op3_chat_formatting"](spark, SF).collect())
    assert got == want
    said = "user\n\\### Assistant: </turn> ok\nassistant\n\\### Assistant: </turn> ok\n"
    assert got[0][:3] == (-7, 2, hashlib.sha256(said.encode()).hexdigest())
