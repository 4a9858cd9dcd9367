"""Secret scans behind a trigram inverted index, in native expressions (operator 10).

From each rule's regular expression a Boolean query over trigrams is derived
that every match must satisfy. Posting lists (trigram, block of documents ->
document ids) are built for the trigrams that queries name, over ASCII
lower-cased text; their intersections and unions give the candidates of each
rule, and only these are verified with the regular expression. Rules lacking
mandatory trigrams scan every text.

Blocks hold about block_docs documents by hash of the key, so no posting list
grows with the corpus. Rows with a null key skip the index and are scanned for
all rules. Null text counts as empty: no spans. Rows that repeat a key are
scanned each on its own. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.native import let, running
from ledgerline.llm.shared import checkpointed

_parse = re._parser.parse  # the standard library's syntax tree of a regular expression


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share. A match counts if the group has least characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in the order that breaks ties, and the further rules of the method.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
]
MOST_STRINGS = 64
BROADCAST_ROWS = 200_000  # of a key and the names of some rules: about 20 MB
Query = frozenset  # of alternatives, each a frozenset of trigrams that must all occur; an empty frozenset of alternatives never arises


def _exact(node: tuple) -> set[str] | None:
    """All strings that the node can match, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg)}
    if op == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _exact_all(arg[3])
    if op == "BRANCH":
        sets = [_exact_all(x) for x in arg[1]]
        out = set().union(*(s or set() for s in sets))
        return out if all(s is not None for s in sets) and len(out) <= MOST_STRINGS else None
    if op == "MAX_REPEAT" and arg[1] <= 2:
        one = _exact_all(arg[2])
        if one is None:
            return None
        return {"".join(c) for n in range(arg[0], arg[1] + 1) for c in itertools.product(one, repeat=n)}
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        got = _exact(node)
        if got is None or len(out) * len(got) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in got}
    return out


def fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def trigrams(text: str) -> frozenset[str]:
    folded = fold(text)
    return frozenset(folded[i : i + 3] for i in range(len(folded) - 2))


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """A conjunction of disjunctions of conjunctions of trigrams; empty if no trigram is mandatory."""
    clauses: list[list[list[str]]] = []

    def flush(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            alternatives = {trigrams(s) for s in strings}
            least = [a for a in alternatives if not any(b < a for b in alternatives)]
            clauses.append(sorted(sorted(a) for a in least))

    def walk(nodes) -> None:
        held = {""}
        for node in nodes:
            got = _exact(node)
            if got is not None and len(held) * len(got) <= MOST_STRINGS:
                held = {a + b for a in held for b in got}
                continue
            flush(held)
            held = {""}
            op, arg = str(node[0]), node[1]
            if op == "SUBPATTERN":
                walk(arg[3])
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                walk(arg[2])
        flush(held)

    walk(_parse(pattern))
    return clauses


_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches that count, as structs of start and end in code points. Time grows with the text's length."""

    def place(found: Column, between: Column, values: Column) -> Column:
        gaps = F.transform(found, lambda m, i: F.length(F.get(between, i)))
        return let(F.struct(running(F.zip_with(gaps, found, lambda g, m: g + F.length(m)), lambda a, b: a + b).alias("before"), gaps.alias("gaps")), lambda x: good(found, values, x["before"], x["gaps"]))

    def good(found: Column, values: Column, before: Column, gaps: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.get(gaps, i)
            return F.when(F.length(F.get(values, i)) >= rule.least, F.struct(start.alias("start"), (start + F.length(m)).alias("end")))

        return F.filter(F.transform(found, one), lambda s: s.isNotNull())

    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    placed = let(F.struct(found.alias("f"), F.split(text, rule.pattern, -1).alias("b"), values.alias("v")), lambda x: place(x["f"], x["b"], x["v"]))
    return F.when(text.rlike(rule.pattern), placed).otherwise(F.array().cast(_SPANS))


def postings(docs: DataFrame, key: str, text: str, wanted: list[str], blocks: int) -> DataFrame:
    """block, trigram, ids: the inverted index of the wanted trigrams."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds = let(folded, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in wanted])))
    terms = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(holds).alias("trigram"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    return terms.groupBy(block, "trigram").agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """id, rules: which rules' queries hold, by intersection and union of posting lists."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast(lists.schema["lists"].dataType.valueType)
    posting = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)

    def both(cols: list[Column]) -> Column:
        out = cols[0]
        for c in cols[1:]:
            out = F.array_intersect(out, c)
        return out

    def either(cols: list[Column]) -> Column:
        out = cols[0]
        for c in cols[1:]:
            out = F.array_union(out, c)
        return out

    def held(query: list) -> Column:
        return both([either([both([posting(t) for t in alternative]) for alternative in clause]) for clause in query])

    def told(kind: str, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(kind).alias("rule")))

    found = [told(kind, held(q)) for kind, q in queries.items()]
    pairs = lists.select(F.explode(F.concat(*found)).alias("p")).select("p.id", "p.rule")
    return pairs.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text", block_docs: int = 4096, carry: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key, text, and spans: an array of (start, kind_order, kind, end) in order of start, then of the rules.

    With carry also the other columns, as the struct `carried`.
    """
    rules = [*BASE_RULES, *MORE_RULES] if rules is None else rules
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    full = [r for r in rules if not queries[r.kind]]
    indexed = {k: q for k, q in queries.items() if q}
    wanted = sorted({t for q in indexed.values() for clause in q for alternative in clause for t in alternative})
    n = docs.select(key).count()
    index = postings(docs, key, text, wanted, max(16, n // block_docs))
    chosen = checkpointed(candidates(index, indexed))
    few = chosen.count() <= broadcast_rows  # else texts and candidates meet in a shuffle
    body = F.coalesce(F.col(text), F.lit(""))
    # full scans run beside the text before it moves
    others = [F.col(c) for c in docs.columns if c not in (key, text)]
    carried = F.struct(*others).alias("carried") if carry and others else F.lit(None).cast("int").alias("carried")
    read = docs.select(F.col(key).alias("id"), body.alias("text"), carried, *[spans(body, r).alias(r.kind) for r in full])
    known = read.where(F.col("id").isNotNull()).join(F.broadcast(chosen) if few else chosen, "id", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    unknown = read.where(F.col("id").isNull()).withColumn("rules", F.array(*[F.lit(k) for k in indexed]).cast("array<string>"))
    met = known.unionByName(unknown)
    none = F.array().cast("array<struct<start:int,end:int>>")
    verified = met.select("id", "text", "carried", *[
        (F.col(r.kind) if r in full else F.when(F.array_contains("rules", r.kind), spans(F.col("text"), r)).otherwise(none)).alias(r.kind) for r in rules
    ])

    def told(order: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    every = [told(k, r.kind) for k, r in enumerate(rules)]
    out = verified.select(F.col("id").alias(key), "text", F.array_sort(F.concat(*every)).alias("spans"), "carried")
    return out if carry else out.drop("carried")


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[REDACTED]", size: int = 8192) -> Column:
    """The text with each span replaced by the mark; overlapping spans become one. found: spans in order of start.

    Pieces of size characters are redacted one by one, so no step walks the whole text.
    """
    gone = "struct<from:int,to:int,fresh:boolean>"

    def cut(piece: Column, base: Column, lost: Column) -> Column:
        """piece: the characters from base on. lost: the ranges that overlap it."""

        def step(a: Column, s: Column) -> Column:
            start = F.greatest(s["from"], base)
            kept = F.substring(piece, a["at"] - base + 1, F.greatest(start - a["at"], F.lit(0)))
            new = F.when(s["fresh"] & (s["from"] >= base), F.array(kept, F.lit(mark))).otherwise(F.array(kept))
            return F.struct(F.greatest(a["at"], s["to"]).alias("at"), F.concat(a["out"], new).alias("out"))

        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(piece, a["at"] - base + 1, F.lit(size)))), "")
        return F.when(F.size(lost) == 0, piece).otherwise(F.aggregate(lost, start, step, rest))

    def cut_all(ranges: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

        def one(piece: Column, k: Column) -> Column:
            return let(F.filter(ranges, lambda s: (s["to"] > k * size) & (s["from"] < (k + 1) * size)), lambda lost: cut(piece, k * size, lost))

        return F.array_join(F.transform(pieces, one), "")

    # what a span adds to those before it: from the largest end so far
    before = running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    ranges = let(before, lambda b: F.transform(found, lambda s, i: F.struct(F.greatest(F.get(b, i), s["start"]).alias("from"), s["end"].alias("to"), (s["start"] >= F.get(b, i)).alias("fresh")).cast(gone)))
    return F.when(F.size(found) == 0, text).otherwise(let(F.filter(ranges, lambda s: s["to"] > s["from"]), cut_all))
