"""Operators 9 and 10 against the tokenizer called on whole texts."""
import zlib
from collections import defaultdict

import numpy as np
import pytest

from concord.llm import packing, token_files
from concord.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


def direct(name, text, end):
    from tokenizers import Tokenizer

    tok = direct.cache.setdefault(name, Tokenizer.from_file(tokenizer_file(name)))
    return tok.encode(text or "", add_special_tokens=False).ids + [end]


direct.cache = {}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_give_any_value_back():
    rng = np.random.default_rng(1)
    for values in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 2**32, 5000), rng.integers(0, 300, 20_000)):
        values = np.array(values, dtype=np.uint32)
        codes = token_files.Codes(token_files.encode(values))
        assert (codes.all() == values).all() if len(values) else len(codes.all()) == 0
        if len(values):
            where = rng.integers(0, len(values), 400)
            assert (codes.take(where) == values[where]).all()
            assert codes[len(values) - 1] == values[-1]
    with pytest.raises(ValueError):
        token_files.encode(np.array([2**17], np.uint32), widths=(8, 8))


def check_files(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(d, direct("word_bpe_49k.json", t, 2)) for d, t in order]
    assert len(got) == len(want)
    got = sorted(got, key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is None, d or 0, len(i), crc(i)) for d, i in want)


def test_token_files_of_odd_rows(spark, docs_of, odd_rows, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(docs_of(odd_rows), path, tokenizer_file("word_bpe_49k.json"), 2, segment_ids=50)
    check_files(odd_rows, token_files.read(spark, path).collect())


def test_token_files_of_no_rows(spark, docs_of, tmp_path):
    path = str(tmp_path / "none")
    token_files.write(docs_of([]), path, tokenizer_file("word_bpe_49k.json"), 2)
    assert token_files.read(spark, path).count() == 0


def test_token_files_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_files(rows, QUERIES["op9_token_files"](spark, SF).collect())


def check_pieces(rows, got, size=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == size or at & (at - 1) == 0 and at < size      # nothing is padded
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(direct("byte_bpe_50k.json", t, 1))
    assert set(want) == set(by_doc)
    for d, docs in want.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, docs))
        for p in by_doc[d]:
            assert any(len(i) == p.doc_tokens and crc(i[p.start:p.start + p.length]) == p.ids_crc32 for i in docs)
        if len(docs) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at
                at += p.length


def test_packing_of_odd_rows(docs_of, odd_rows):
    for fanin in (1, 2, 256):
        got = packing.pack(docs_of(odd_rows), tokenizer_file("byte_bpe_50k.json"), 1, size=64, open_windows=2, merge_fanin=fanin).collect()
        check_pieces(odd_rows, got, 64)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_packing_of_no_rows(docs_of):
    assert packing.pack(docs_of([]), tokenizer_file("byte_bpe_50k.json"), 1).count() == 0


def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(rows, QUERIES["op10_packing"](spark, SF).collect())


def test_long_words_take_one_pass():
    from tokenizers import Tokenizer

    from concord.llm.tokens import WordEncoder

    texts = [a * 10_000 + b for a in ("a", "é", "Word", "a.") for b in ("_", "-", "7", ",", "")]
    texts += ["a" * 5000 + "\n" + "b" * 5000 + c for c in ("", "_", "\n", "\n\nz")] + [" ".join(["conclusion.\nInternational-"] * 200), "ª º µ ÷ × a÷b"]
    for name, blanks in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        tok, enc = Tokenizer.from_file(tokenizer_file(name)), WordEncoder(tokenizer_file(name), blanks)
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_a_text_of_five_megabytes(docs_of):
    text = " ".join(f"word{i} paragraphical,\nnext" for i in range(180_000))
    got = packing.pack(docs_of([(1, text)]), tokenizer_file("byte_bpe_50k.json"), 1).drop("ids").collect()
    assert len(text) > 5_000_000 and sum(r.length for r in got) == len(direct("byte_bpe_50k.json", text, 1))


ADDED = ["foo <|endoftext|> bar", "foo<|endoftext|>bar  x", "<|startoftext|>A b", "<|EndOfText|> Plain TEXT", "no token at all"]


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_as_by_the_plain_call(name, blanks):
    from tokenizers import Tokenizer

    from concord.llm.tokens import WordEncoder

    tok = Tokenizer.from_file(tokenizer_file(name))
    enc = WordEncoder(tokenizer_file(name), blanks, added_tokens=True)
    for t in ADDED * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_queries_give_added_tokens_their_ids(spark, docs_of, monkeypatch):
    from tokenizers import Tokenizer

    from concord.llm import queries

    monkeypatch.setattr(queries, "read_table", lambda *_: docs_of(list(enumerate(ADDED))))
    for query, name, end in (("op9_token_files", "word_bpe_49k.json", 2), ("op10_packing", "byte_bpe_50k.json", 1)):
        tok = Tokenizer.from_file(tokenizer_file(name))
        want = {i: tok.encode(t, add_special_tokens=False).ids + [end] for i, t in enumerate(ADDED)}
        got = QUERIES[query](spark, SF).collect()
        if query == "op9_token_files":
            assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(w), crc(w)) for i, w in want.items()}
        else:
            assert all(r.doc_tokens == len(want[r.doc_id]) and crc(want[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 for r in got)


def test_packing_writes_and_returns_all_ids(spark, docs_of, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    text = "words to pack " * 1500                # full sequences and a remainder
    kept = corpus_pipeline.pack(spark, docs_of([(1, text), (2, "short")]), SF).collect()
    ids = {}
    for r in sorted(kept, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert {d: np.frombuffer(b, "<u4").tolist() for d, b in ids.items()} == {1: direct("byte_bpe_50k.json", text, 1), 2: direct("byte_bpe_50k.json", "short", 1)}
    # the query's digests come from ids that were written
    written = []
    monkeypatch.setattr(packing, "saved", lambda df, label, plain=packing.saved: written.append(plain(df, label)) or written[-1])
    n = QUERIES["op10_packing"](spark, SF).agg(F.sum("length")).first()[0]
    assert n == sum(w.where("sequence_id <> -1").agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] for w in written) // 4
