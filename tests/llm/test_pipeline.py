"""The pipeline against the stages spelled out in plain Python."""

import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from leaselight.llm.queries import TOKENIZER_PATH

from . import test_decontaminate, test_quality, test_secrets

DATA = Path("/root/testdata/sf0.001")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_run_against_brute_force(spark):
    docs = pq.read_table(DATA / "documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(DATA / "benchmark.parquet").to_pylist()]
    kept = []
    for d in docs:
        n, chars, symbols, dup, repeat = test_quality.plain(d["text"])
        lines = d["text"].split("\n")
        bad = n < 20 or 100 * repeat > 30 * n or symbols * 4 > n or chars > n * 20 or chars < n * 2 or dup * 2 > len(lines)
        bad = bad or len(re.findall(r"[A-ZÀ-ÖØ-Þ]{3}", d["text"])) * 3 > n
        if not bad:
            kept.append(d)
    sets = [shingles(d["text"]) for d in kept]
    roots = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):  # four fifths of all shingles
                roots = [roots[j] if r == roots[i] else r for r in roots]
    best = {}
    for root, d in zip(roots, kept):
        best[root] = min(best.get(root, d["doc_id"]), d["doc_id"])
    kept = [d for root, d in zip(roots, kept) if best[root] == d["doc_id"]]
    kept = [d for d in kept if test_decontaminate.plain(d["text"], items)[1] == 0]
    library = Tokenizer.from_file(TOKENIZER_PATH)
    want = {}
    for d in kept:
        text, done, out = d["text"], 0, ""
        for start, end, _ in test_secrets.plain(text):
            if start >= done:
                out += text[done:start] + "[SECRET]"
            done = max(done, end)
        text = out + text[done:]
        want[d["doc_id"]] = library.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert got == want
    assert 0 < len(got) < len(docs)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, spans string, N_Words string, kept string, node string, simhash string, item_ids string, component_id string, ids string, decoded string, text_key string"


def test_odd_rows_and_clashing_columns(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 30, "en", "s", 1), (3, prose + " password=abcdef99", "en", "s", 1), (3, prose + " password=abcdef99", "en", "s", 1), (4, prose + " password=abcdef99", None, None, None), (None, prose, "en", "s", 2)]
    docs = spark.createDataFrame([(*r, *(f"own{i}" for i in range(10))) for r in rows], CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(tuple(r)[5:] == tuple(f"own{i}" for i in range(10)) for r in kept), name
        ids = sorted((-1 if r.doc_id is None else r.doc_id for r in kept))
        want = {"quality rules": [-1, 3, 3, 4], "SimHash near-dedup": [-1, -1, 1, 3], "benchmark decontamination": [-1, -1, 1, 2, 3, 3, 4], "secret scans": [-1, -1, 1, 2, 3, 3, 4]}[name]
        assert ids == want, name
        if name == "secret scans":
            assert {r.text for r in kept if r.doc_id == 4} == {prose + " [SECRET]"} and {(r.text, r.n_chars) for r in kept if r.doc_id == 2} == {("", 0)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).count() == len(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(DATA)).count() == 0, name
