import hashlib
import random
import re

from coldhaul.llm import phrases
from llm_data import DOC_SCHEMA, SF, clashing, messy, rows_of, sf_documents

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        k = min(size, len(w))
        for i in range(len(w) - k + 1):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for r in docs:
        w, hit, found = words(r["text"]), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (ids := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((r["doc_id"], len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
ITEM = "item_id long, text string"


def test_equals_brute_force_on_the_test_tables(spark):
    docs, items = sf_documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows_of(phrases.decontamination(docs, items), *COLUMNS)
    assert got == brute(docs.collect(), [(r["item_id"], r["text"]) for r in items.collect()])
    assert any(r[-1] for r in got)


def test_equals_brute_force_on_few_words_and_odd_items(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("aB cd E éf").strip() or "x" for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).unionByName(messy(spark))
    long = " ".join(texts[3].split()[:20] + ["tail"])
    items = [(10, long), (2, "the LAZY, dog"), (2, "the lazy dog"), (3, "one"), (None, "quick"), (4, None), (5, "..."), (6, texts[7]), (1, "nowhere at all")]
    items += [(7, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 word17 word18 word19")]
    benchmark = spark.createDataFrame(items, ITEM)
    assert rows_of(phrases.decontamination(docs, benchmark), *COLUMNS) == brute(docs.collect(), items)


def test_proximity_matches_have_the_rare_terms_in_place(spark):
    item = " ".join(f"w{i}" for i in range(13))
    near = item.replace("w7", "other")
    filler = " ".join(["w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"] * 5)
    docs = spark.createDataFrame([(1, item, "", ""), (2, near, "", ""), (3, filler, "", "")], DOC_SCHEMA)
    got = {r["doc_id"]: r for r in phrases.decontamination(docs, spark.createDataFrame([(1, item)], ITEM)).collect()}
    assert [(got[i]["n_items"], got[i]["n_near_items"]) for i in (1, 2, 3)] == [(1, 0), (0, 1), (0, 0)]


def test_stage_keeps_clean_documents_with_their_columns(spark):
    docs = clashing(messy(spark))
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], ITEM)
    out = phrases.clean_documents(docs, items)
    assert out.columns == docs.columns
    assert all("quick brown fox" not in (r["text"] or "") for r in out.collect())
    assert out.count() == docs.where("text is null or not text like '%quick brown%'").count()


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([], ITEM)
    docs = messy(spark)
    assert phrases.decontamination(no_docs, spark.createDataFrame([(1, "a b")], ITEM)).collect() == []
    assert rows_of(phrases.decontamination(docs, no_items), *COLUMNS) == brute(docs.collect(), [])
