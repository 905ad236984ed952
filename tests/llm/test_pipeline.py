"""The pipeline against a brute-force version on a small fixture."""

from collections import Counter

import corpus_pipeline
import test_near_copies
import test_packing
import test_phrases
import test_quality
import test_secrets
from coldhaul.llm import quality
from coldhaul.llm.common import stored
from llm_data import SF, clashing, messy

LARGER = "/root/testdata/sf0.01"  # the smallest with secrets

MEASURED = {
    "symbol_permille": lambda n, chars, symbols, dups, repeats, lines: 1000 * symbols // chars if chars else 0,
    "dup_line_permille": lambda n, chars, symbols, dups, repeats, lines: 1000 * dups // lines if lines else 0,
    "repeat_permille": lambda n, chars, symbols, dups, repeats, lines: 1000 * repeats // n if n else 0,
    "word_centi": lambda n, chars, symbols, dups, repeats, lines: 100 * chars // n if n else 0,
    "n_words": lambda n, chars, symbols, dups, repeats, lines: n,
    "word_chars": lambda n, chars, symbols, dups, repeats, lines: chars,
    "n_lines": lambda n, chars, symbols, dups, repeats, lines: lines,
}


def kept(rows):
    counted = []
    for r in rows:
        n, chars, symbols, dups, repeats, failed = test_quality.brute(r["text"])
        lines = sum(bool(line.strip("\t\n\x0b\x0c\r ")) for line in (r["text"] or "").split("\n"))
        counted.append((r, failed, {m: f(n, chars, symbols, dups, repeats, lines) for m, f in MEASURED.items()}))
    good = [(r, m) for r, failed, m in counted if not failed]

    def group(r):
        for same in (("lang", "source"), ("lang",), ()):
            found = [m for g, m in good if all(g[c] == r[c] for c in same)]
            if len(found) >= 50:
                return found
        return []

    out = []
    for r, failed, m in counted:
        peers = [] if failed else group(r)
        inside = all(
            (m[f.measure] >= edge if f.below else m[f.measure] <= edge)
            for f in quality.FENCES
            for edge in [test_quality.fence_by_hand(peers, f) if peers else m[f.measure]]
        )
        if not failed and inside:
            out.append(r)
    return out


def brute(rows, items):
    rows = kept(rows)
    component = {d: c for d, _, c in test_near_copies.brute(rows)}
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    bad = {r[0] for r in test_phrases.brute(rows, items) if r[-1]}
    out = []
    for r in rows:
        if r["doc_id"] in bad:
            continue
        text, at, masked = r["text"], 0, ""
        for a, _, b, _ in test_secrets.brute(text):
            if a >= at:
                masked += text[at:a] + "[SECRET]"
            at = max(at, b)
        out.append({**r.asDict(), "text": masked + text[at:]})
    return out


def test_the_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert 0 < len(want) < len(docs) and any("[SECRET]" in r["text"] for r in want)
    test_packing.check(want, corpus_pipeline.run(spark, LARGER).collect(), 2048)


def test_stages_keep_all_columns_and_survive_messy_rows(spark):
    docs = clashing(messy(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert not Counter(r["doc_id"] for r in after.collect()) - Counter(r["doc_id"] for r in docs.collect())
        docs = after


def test_stages_in_order():
    names = ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
