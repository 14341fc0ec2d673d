"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame functions only.

What the fixed patterns find are seed entities. The words before an entity are a lexical pattern, so are
those after it, and so is the nearest word on either side with the entity's shape; patterns and instances
form a graph. In each round a pattern scores by how many of its instances are known, an instance by the
patterns it stands in. Identifier-shaped tokens and groups of digits that no fixed pattern matches, but
that well-supported, high-confidence patterns vouch for, are personal data too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import grouped, materialise

#: Fixed patterns. Look-behinds and possessive repeats keep the matches and make the search linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Up to eight groups of digits with one blank, hyphen or dot between them, or bracketed; else a token with a digit.
TOKEN = (
    r"(?<![A-Za-z0-9._%+@-])(?:\(?[0-9]++\)?(?:[\x20.-]?\(?[0-9]++\)?){1,7}+(?![A-Za-z0-9@])"
    r"|[A-Za-z._%+@-]*+[0-9][A-Za-z0-9._%+@-]*+)"
)
#: The form of a card or an address that has failed its test: no identifier of any kind.
FAILED = r"^(?:[0-9](?:[\x20-]?[0-9]){12,18}|[0-9]+(?:\.[0-9]+){3})$"
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": "[0-9]"}
SPAN = "struct<kind: string, start: int, end: int, value: string, before: array<string>, after: array<string>>"
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(gap: Column, before: bool, reach: int = 60) -> Column:
    """The two words next to a match, in lower case, the nearest first."""
    found = F.regexp_extract_all(F.lower(F.right(gap, F.lit(reach)) if before else F.left(gap, F.lit(reach))), F.lit(WORD), F.lit(0))
    return F.slice(F.reverse(found) if before else found, 1, 2)


def _running(sizes: Column) -> Column:
    """Running sums of an array, in blocks of about the root of its length: no array grows element by element over all of it."""

    def blocked(x: Column) -> Column:
        def sums(part: Column) -> Column:
            return F.aggregate(part, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)), lambda acc: F.slice(acc, F.lit(2), F.size(acc) - 1))

        def shifted(parts: Column) -> Column:
            ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(p, -1))))
            return _let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda v: v + e[i]))))

        step = F.ceil(F.sqrt(F.size(x))).cast("int")
        starts = lambda n: F.sequence(F.lit(1), F.size(x), n)
        return _let(F.transform(_let(step, starts), lambda at: sums(F.slice(x, at, step))), shifted)

    return _let(sizes, lambda x: F.when(F.size(x) > 0, blocked(x)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of the leftmost non-overlapping matches; positions in code points, end exclusive."""

    def build(x: Column) -> Column:
        sizes = F.transform(x["hits"], lambda h, i: F.char_length(x["gaps"][i]) + F.char_length(h))

        def one(h: Column, i: Column, ends: Column) -> Column:
            beside = (_words(x["gaps"][i], True).alias("before"), _words(x["gaps"][i + 1], False).alias("after"))
            return F.struct(F.lit(kind).alias("kind"), (ends[i] - F.char_length(h)).alias("start"), ends[i].alias("end"), h.alias("value"), *beside).cast(SPAN)

        return _let(_running(sizes), lambda ends: F.transform(x["hits"], lambda h, i: one(h, i, ends)))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(HINTS[kind]), _let(both, build)).otherwise(_empty())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    return (
        F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda acc, i: acc + _let(digits.substr(n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
        )
        % 10
        == 0
    )


def _valid(kind: str):
    def test(s: Column) -> Column:
        size = F.char_length(_digits(s["value"]))
        if kind == "ip":
            return s["value"].rlike(r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$")
        if kind == "card":
            return F.when(size.between(13, 19), luhn(_digits(s["value"]))).otherwise(False)
        if kind == "phone":
            return size.between(9, 15)
        return F.lit(True)

    return test


def _shape(value: Column) -> Column:
    """The value with 9 for each digit and a for each run of letters."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]+", "a")


def _patterns(s: str) -> Column:
    """Patterns that an entity stands in, each with its sort."""
    shape = _shape(F.col(f"{s}.value"))
    sides = [(side, F.col(f"{s}.{side}")) for side in ("before", "after")]
    found = [F.concat_ws(" ", F.lit(f"{side} with shape"), words[0], shape) for side, words in sides]
    found += [F.concat_ws(" ", F.lit(side), words) for side, words in sides]
    there = [F.when(F.size(words) > n, pattern) for pattern, (_, words), n in zip(found, sides * 2, (0, 0, 1, 1), strict=True)]
    return F.filter(F.array(*there), lambda p: p.isNotNull())


def _apart(entities: DataFrame) -> DataFrame:
    """Without the tokens that overlap a seed of their row."""
    up, down = (Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("s.start", "s.end", "s.kind"), (F.desc("s.start"), F.desc("s.end"), F.desc("s.kind"))))
    seed = F.col("s.kind") != "token"
    reached = F.max(F.when(seed, F.col("s.end"))).over(up)
    ahead = F.min(F.when(seed, F.col("s.start"))).over(down)
    clear = (F.coalesce("reached", F.lit(-1)) <= F.col("s.start")) & F.coalesce(F.col("ahead") >= F.col("s.end"), F.lit(True))
    return entities.withColumns({"reached": reached, "ahead": ahead}).where(seed | clear).drop("reached", "ahead")


def find_pii(
    docs: DataFrame, rounds: int = 3, min_seeds: int = 3, threshold: float = 0.7, min_digits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, base, extra): spans of the fixed patterns, by kind and start, and those the contexts add.

    A span has kind, start, end (code points, end exclusive), value and the two words before and after
    it. An extra span takes the kind of the seeds it stands among. A pattern counts if at least
    ``min_seeds`` different seeds of the kind stand in it; a token counts from a score of ``threshold`` on
    and if it has ``min_digits`` digits and six characters; what has the form of a card or an address and fails its test is none. The words
    are those within 60 characters of the entity, and a token of digits has eight groups at most. One row for each row of ``docs``; null and
    empty texts have no spans; ids may be null or repeat; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    shaped = lambda s: (s["end"] - s["start"] >= 6) & (F.char_length(_digits(s["value"])) >= min_digits) & ~s["value"].rlike(FAILED)
    scanned = docs.select(
        F.col(id_col).alias("doc_id"),
        *(F.filter(spans(text, kind, pattern), _valid(kind)).alias(kind) for kind, pattern in PATTERNS.items()),
        F.filter(spans(text, "token", TOKEN), shaped).alias("token"),
    )
    table = materialise(scanned.withColumn("row", F.monotonically_increasing_id()).withColumn("base", F.concat(*KINDS)).drop(*KINDS))
    entities = table.where((F.size("base") > 0) | (F.size("token") > 0)).select("row", F.explode(F.concat("base", "token")).alias("s"))
    entities = materialise(
        _apart(entities).select("row", "s", F.col("s.kind").alias("kind"), _patterns("s").alias("patterns"), F.md5("s.value").alias("instance"))
    )
    edges = materialise(entities.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct())
    sizes = grouped(edges.select("pattern", "instance").distinct(), ["pattern"], n=F.count("*"))
    support = grouped(edges.where(F.col("kind") != "token"), ["pattern", "kind"], seeds=F.count("*")).where(F.col("seeds") >= min_seeds)
    useful = materialise(support.join(sizes, "pattern"))
    links = materialise(
        edges.select("pattern", "instance").distinct().join(grouped(useful, ["pattern"], seeds=F.max("seeds")).select("pattern"), "pattern")
    )
    known = edges.where(F.col("kind") != "token").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = known
    for _ in range(rounds):
        held = grouped(links.join(scores, "instance"), ["pattern", "kind"], held=F.sum("score"))
        trust = useful.join(held, ["pattern", "kind"]).select("pattern", "kind", (F.col("held") / (F.col("n") + 1)).alias("trust"))
        reached = links.join(trust, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"))
        scores = materialise(
            reached.join(known.select("instance", "kind", F.lit(True).alias("seed")), ["instance", "kind"], "left").select(
                "instance", "kind", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score")
            )
        )
    best = grouped(scores.where(F.col("score") >= threshold), ["instance"], new_kind=F.max_by("kind", F.struct("score", "kind")))
    new = F.struct(F.col("new_kind").alias("kind"), "s.start", "s.end", "s.value", "s.before", "s.after")
    extra = entities.where(F.col("kind") == "token").join(best, "instance").groupBy("row").agg(F.array_sort(F.collect_list(new)).alias("extra"))
    return table.join(extra, "row", "left").select("doc_id", "base", F.coalesce("extra", _empty()).alias("extra"))


def span_text(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    rank = lambda s: reduce(lambda rest, k: F.when(s["kind"] == KINDS[k], k).otherwise(rest), range(len(KINDS)), F.lit(len(KINDS)))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
