"""Secret scans over a trigram inverted index, in built-in functions only.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: literals give their
trigrams in conjunction, alternatives a disjunction. The index holds, for the trigrams that rules mention, the
documents that contain them; postings are intersected per rule and only the documents that satisfy a query are
verified by the expression itself. A rule without a mandatory trigram (a run of hexadecimal digits) scans fully.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need

try:  # the parser's module was renamed
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """regex holds for Python and Java alike; value_group/min_value: a match whose group is shorter is dropped."""

    kind: str
    regex: str
    base: bool = True
    value_group: int = 0
    min_value: int = 0


#: The expressions and lengths that the contract names, then two kinds that the method adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", True, 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", False, 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 27),
)

#: Candidates that are sent to all tasks at most (an id and some kinds each); beyond it texts are shuffled to them.
BROADCAST_HITS = 1_000_000

#: A query: ("all", ...) or ("any", ...) of queries, a trigram, or None where nothing is mandatory.
Query = tuple | str | None


def _both(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("all", *parts)


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("any", *parts)


def _trigrams(text: str) -> list[Query]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


#: Alternatives of exact strings that a sequence may carry along while it grows.
_MOST_STRINGS = 16


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The exact strings a sequence can match (None: not a small set), and its mandatory query."""
    strings: set[str] | None = {""}
    found: list[Query] = []

    def flush() -> None:
        nonlocal strings
        if strings and all(len(s) >= 3 for s in strings):
            found.append(_either([_both(_trigrams(s)) for s in sorted(strings)]))
        strings = None

    for op, arg in nodes:
        part: set[str] | None = None
        if op is _c.LITERAL:
            part = {chr(arg).lower()}
        elif op is _c.SUBPATTERN:
            part, query = _walk(arg[-1])
            if part is None:
                found.append(query)
        elif op is _c.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(b[0] is not None for b in branches):
                part = set().union(*(b[0] for b in branches))
            else:
                found.append(_either([_both([_either([_both(_trigrams(s)) for s in sorted(b[0])]) if b[0] else b[1]]) for b in branches]))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
            inner, _ = _walk(arg[2])
            part = inner | {""} if inner is not None else None
        elif op is _c.IN and all(k is _c.LITERAL for k, _ in arg) and len(arg) <= 6:
            part = {chr(v).lower() for _, v in arg}
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            found.append(_walk(arg[2])[1])
        if part is not None and strings is not None and len(strings) * len(part) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in part}
        else:
            flush()
            strings = part
    if found or strings is None:
        flush()
        return None, _both(found)
    return strings, _either([_both(_trigrams(s)) for s in sorted(strings)])


def trigram_query(regex: str) -> Query:
    """The Boolean query over lower-cased trigrams that every match of an expression satisfies; None: no such query."""
    return _walk(_p.parse(regex))[1]


def query_trigrams(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*map(query_trigrams, q[1:]))


def build_index(docs: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """The inverted index's postings, ``gram, id_col``: for each trigram that a rule's query mentions, the documents
    that contain it. A document gives one posting a trigram at most, so the index is bounded by rules times documents.
    """
    low = docs.select(id_col, F.lower(F.col(text_col)).alias("_low"))
    held = F.filter(F.array(*(F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams)), lambda x: x.isNotNull())
    return low.select(id_col, F.explode(held).alias("gram"))


def candidates(index: DataFrame, id_col: str, queries: dict[str, Query]) -> DataFrame:
    """Intersects postings: ``id_col, kinds``, the rules whose query a document satisfies.

    Postings meet by document, never by trigram: a trigram that all documents hold makes no hot group, and a
    group holds as many rows as the rules have trigrams at most.
    """
    held = index.groupBy(id_col).agg(F.collect_set("gram").alias("_grams"))
    kinds = F.filter(F.array(*(F.when(satisfies(q, F.col("_grams")), F.lit(k)) for k, q in queries.items())), lambda x: x.isNotNull())
    return held.select(id_col, kinds.alias("kinds")).where(F.size("kinds") > 0)


def satisfies(q: Query, grams: Column) -> Column:
    """Whether a document's postings meet a query."""
    if q is None:
        return F.lit(True)
    if isinstance(q, str):
        return F.array_contains(grams, q)
    out = satisfies(q[1], grams)
    for x in q[2:]:
        out = out & satisfies(x, grams) if q[0] == "all" else out | satisfies(x, grams)
    return out


_SPAN_TYPE = "array<struct<start:int,ord:int,kind:string,stop:int>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans as an array of struct(start, kind order, kind, end), in code points, end exclusive.

    What lies between matches and what matches alternate, so that running lengths give the places.
    """
    pattern = F.lit(rule.regex)
    between = F.split(text, rule.regex, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value_group))
    rows = F.zip_with(
        F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))),
        values,
        lambda x, v: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.length(v).alias("v")),
    )
    rows = F.filter(rows, lambda x: x["m"].isNotNull())
    empty = F.array().cast(_SPAN_TYPE)
    folded = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + x["m"]).alias("at"),
            F.when(
                x["v"] >= rule.min_value,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["b"] + x["m"]).alias("stop")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.rlike(text, pattern), folded).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Finds each rule's leftmost non-overlapping matches in every whole text.

    Returns ``id_col, spans`` (array of struct<start,ord,kind,stop>, by start, then rule order), a row per input
    row: repeated rows give repeated results, a null text counts as empty, an empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    grams = sorted(set().union(set(), *map(query_trigrams, queries.values())))
    base = need(docs, **{id_col: "long", text_col: "string"}).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if grams:
        # the texts stay where they are while candidates are few enough to be sent to them
        scratch = Scratch(docs.sparkSession, "secrets")
        hits = scratch.write(candidates(build_index(base, "_id", "_text", grams), "_id", queries).withColumnRenamed("_id", "_hit"), "hits")
        hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
        base = base.join(hits, F.col("_id").eqNullSafe(F.col("_hit")), "left")
    else:
        base = base.withColumn("kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast(_SPAN_TYPE)
    held = F.coalesce(F.col("kinds"), F.array().cast("array<string>"))
    found = [F.when(F.array_contains(held, r.kind), spans).otherwise(empty) if r.kind in queries else spans for i, r in enumerate(rules) for spans in [_spans(F.col("_text"), r, i)]]
    return base.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*found)).alias("spans"))


def secrets_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's digest: counts of the base kinds, SHA-256 of the base spans and all spans as text."""
    s = F.col("spans")
    base = [r.kind for r in rules if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return scan_secrets(docs, rules=rules).select("doc_id", *counts, F.sha2(_joined(F.filter(s, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), _joined(s).alias("spans"))
