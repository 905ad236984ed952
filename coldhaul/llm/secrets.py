"""Secret scan: fixed patterns, and character Markov models that add what they miss.

Two first-order Markov models over characters are trained from labelled samples: the
values found by the fixed patterns are random strings, all other words are ordinary
identifiers. A token that is not inside a pattern match is added as a span when its
log-likelihood ratio is above a threshold, both as a total, which a short token only
reaches if it is very unlike an identifier, and per transition. Log probabilities are
whole thousandths, so that sums do not depend on their order.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldhaul.llm.common import least_hash_sample, whole_text

# The patterns of the base rule.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same spans as AKIA[A-Z0-9]+ of 20 and more characters
HEX = r"[0-9a-f]{24,}"  # the same spans as [0-9a-f]+ of 24 and more characters
ASSIGNED_LENGTH = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1
WORD = r"[A-Za-z0-9+/_=-]{4,}"
NO_SPANS = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def matches(text: str, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches, leftmost and not overlapping; the gaps between them come from a split.

    Only texts with a match go beyond the first test. A match whose ``group`` is
    shorter than ``least`` is dropped after it has taken its place.
    """
    p = json.dumps(pattern)
    order = KINDS.index(kind) if kind in KINDS else len(KINDS)
    rows = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> struct(length(g) as g, m as m))"
    if group:
        rows = f"zip_with({rows}, regexp_extract_all({text}, {p}, {group}), (r, v) -> struct(r.g as g, r.m as m, v as v))"
    else:
        rows = f"transform({rows}, r -> struct(r.g as g, r.m as m, r.m as v))"
    empty = f"cast(array() as {NO_SPANS})"
    step = (
        f"(a, r) -> if(r.m is null, a, struct(a.at + r.g + length(r.m) as at, if(length(r.v) < {least}, a.out, concat(a.out,"
        f" array(struct(a.at + r.g as start, {order} as ord, a.at + r.g + length(r.m) as end, '{kind}' as kind, r.v as value)))) as out))"
    )
    found = f"aggregate({rows}, struct(0 as at, {empty} as out), {step}, a -> a.out)"
    return F.expr(f"if({text} rlike {p}, {found}, {empty})")


def with_base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, the text ``t`` and its ``base`` spans by start, then kind."""
    texts = docs.select(*[F.col(c) for c in keep], whole_text(docs).alias("t"))
    base = F.concat(
        matches("t", ASSIGN, "assign", group=2, least=ASSIGNED_LENGTH), matches("t", ACCESS, "access"), matches("t", HEX, "hex")
    )
    return texts.select(*keep, "t", F.array_sort(base).alias("base"))


def transitions(words: DataFrame) -> DataFrame:
    """(label, from, to, n) over the characters of (label, word); 0 is the start and any other character."""
    pairs = F.expr(f"""transform(sequence(0, length(word) - 1), i -> struct(
        if(i = 0, 0, instr('{ALPHABET}', substr(word, i, 1))) as f, instr('{ALPHABET}', substr(word, i + 1, 1)) as t))""")
    each = words.where("length(word) > 0").select("label", F.explode(pairs).alias("x"))
    return each.groupBy("label", "x.f", "x.t").agg(F.count("*").alias("n"))


def log_ratio(counts: list[tuple[str, int, int, int]], weight: int = 10) -> list[int]:
    """Thousandths of log P(random) - log P(ordinary) for each transition.

    A transition is smoothed with ``weight`` observations of how common the character
    is anywhere, which itself is smoothed by one.
    """
    logs = {}
    for label in ("random", "ordinary"):
        n = [[0] * STATES for _ in range(STATES)]
        for name, f, t, k in counts:
            if name == label:
                n[f][t] += k
        any_from = [1 + sum(n[f][t] for f in range(STATES)) for t in range(STATES)]
        total = sum(any_from)
        logs[label] = [
            math.log((n[f][t] + weight * any_from[t] / total) / (sum(n[f]) + weight)) for f in range(STATES) for t in range(STATES)
        ]
    return [round(1000 * (a - b)) for a, b in zip(logs["random"], logs["ordinary"])]


def train(docs: DataFrame, sample_docs: int = 5_000) -> list[int]:
    """The table of log ratios, from a bounded sample of ``sample_docs`` distinct texts of least hash.

    Each sampled text labels its own strings: values of base spans are random, its
    other words ordinary; each distinct string counts once. The driver gets at most 2 * 68 * 68 counts.
    """
    chosen = least_hash_sample(docs, sample_docs)
    base = with_base_spans(chosen, [])
    random = base.select(F.lit("random").alias("label"), F.explode("base.value").alias("word"))
    rest = F.array_except(F.expr(f"regexp_extract_all(t, {json.dumps(WORD)}, 0)"), F.col("base.value"))
    ordinary = base.select(F.lit("ordinary").alias("label"), F.explode(rest).alias("word"))
    counted = transitions(random.unionByName(ordinary).distinct()).collect()
    return log_ratio([(r["label"], r["f"], r["t"], r["n"]) for r in counted])


def scan(
    docs: DataFrame, keep: list[str], model: list[int], threshold: int = 400, total: int = 7_000, least: int = 10
) -> DataFrame:
    """``keep``, the text ``t``, its ``base`` spans and all ``spans`` by start, then kind.

    A token of ``least`` and more characters is added if it is not inside a base span,
    its log ratio is above ``total`` and its mean above ``threshold`` thousandths. It may
    overlap a base span that it sticks out of. Below ``least`` characters random strings
    and names can hardly be told apart.
    """
    table = f"from_json('{json.dumps(model)}', 'array<int>')"
    base = with_base_spans(docs, keep)
    tokens = matches("t", f"[A-Za-z0-9+/_=-]{{{least},}}", "markov")
    score = f"""aggregate(sequence(0, length(x.value) - 1), 0, (s, i) -> s + element_at({table},
        1 + {STATES} * if(i = 0, 0, instr('{ALPHABET}', substr(x.value, i, 1))) + instr('{ALPHABET}', substr(x.value, i + 1, 1))))"""
    found = base.select(*keep, "t", "base", tokens.alias("tokens"))
    chosen = f"""filter(tokens, x -> not exists(base, b -> b.start <= x.start and x.end <= b.end)
        and {score} > greatest({total}, {threshold} * length(x.value)))"""
    return found.select(*keep, "t", "base", F.array_sort(F.concat("base", F.expr(chosen))).alias("spans"))


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans.

    Null and empty texts have no spans. Equal rows get equal results, an empty table
    none; other columns are ignored. Without samples of one label the models rest on
    the smoothing alone.
    """
    docs = docs.select("doc_id", "text")
    rows = scan(docs, ["doc_id"], train(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id",
        *counts[:3],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_markov"),
    )


def masked_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All documents with their columns; each span in the text is replaced by ``mask``.

    Spans that overlap are masked once. ``n_chars`` follows the text if there is such
    a column; a null text stays null, an empty table gives no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    rows = scan(whole, ["whole"], train(whole))
    text = F.expr(f"""if(size(spans) = 0, t, aggregate(spans, struct(0 as at, '' as out), (a, s) -> if(s.start < a.at,
        struct(greatest(a.at, s.end) as at, a.out as out),
        struct(s.end as at, concat(a.out, substr(t, a.at + 1, s.start - a.at), '{mask}') as out)),
        a -> concat(a.out, substr(t, a.at + 1))))""")
    rows = rows.select("whole", F.when(F.col("whole.text").isNotNull(), text).alias("masked"))
    changed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("masked").isNull(), F.col("whole.n_chars")).otherwise(
            F.length("masked").cast(docs.schema["n_chars"].dataType)
        )
    return rows.select(*[changed.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
