"""Personal data: pattern spans, and identifiers found by bootstrapped contexts.

All of it is built-in column functions; no Python runs on the executors.

Base spans come from four patterns. Spark's regular expressions backtrack with
recursion, so on very long matches groups that repeat overflow the stack. The
texts are therefore rewritten first, one code point for one, so that a separator
that can only stand inside a match becomes a stand-in character; what is left
needs runs of single characters only, and the spans are the same.

The bootstrapping is a graph between patterns and instances (identifiers):

* a pattern is what is joined to the identifier on its left, that with one word
  or two words before, or that with the word after; digits in it are one shape;
* base entities, tokens that begin like a published kind of key (``SECRET_FORMS``)
  and hexadecimal literals of a digest's length that a quote or an equals sign leads
  are the seeds, with score 1; such literals elsewhere, which may be anything, start
  at a half, other identifier-like tokens, which hold digits, at 0. A seed is a first
  guess and nothing more: it is not added for what it is;
* a pattern's score is the mean score of its distinct instances, if it has
  ``support`` of them whose score is a half or more; an instance's is the
  noisy-or of its patterns' scores;
* after ``rounds`` the tokens that lie outside the base spans and stand in a pattern
  of ``confidence`` or more are added as kind ``other``, whatever their form. A
  pattern without a letter (a bare quote, say) names nothing and adds nothing, nor
  does one without ``support`` seeds of score 1: digests alone make none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialise, outer_id

KINDS = ("email", "ip", "card", "phone")
_SALTS = 16
RUN = 128
#: A private-use character in place of an inner separator, and what stands for the same character in the text.
_MARK, _TAKEN = "\ue000", "\ue001"
_LOCAL = r"A-Za-z0-9._%+\-" + _MARK
_LABEL = "A-Za-z0-9-"
_TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
#: (what becomes the mark, the pattern after that) for each kind.
_PATTERNS = {
    "email": (rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{_MARK}[{_LABEL}{_MARK}]++"),
    "ip": (None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?<=[0-9])[\x20-](?=[0-9])", rf"[0-9][0-9{_MARK}]++"),
    "phone": (None, r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Public forms of keys and tokens.
SECRET_FORMS = (
    "AKIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36}", "xox[abp]-[A-Za-z0-9-]{10,}", "sk-[A-Za-z0-9-]{20,}",
)
#: Lengths of digests in hexadecimal; such a literal is a seed of score 1 only if a quote or an equals sign is joined to it on the left.
_LITERAL, _LED = "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", "joined .*[\"'=]$"
#: A pattern with a letter besides its kind's name.
_NAMES = r"^[a-z]+ .*\p{L}"
#: A character that every match of the kind has.
_NEEDS = {"email": "@", "phone": "+"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str) -> Column:
    """Matches as an array of (start, end, value, before); before: what precedes since the last match."""
    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(values)).alias("before"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["before"])
        end = begin + F.length(pair["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"), pair["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def placed(pairs: Column) -> Column:
        # Appending copies what is there, so matches are placed in runs of RUN, and the runs then moved to where they begin.
        firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(RUN))
        runs = F.transform(firsts, lambda i: F.aggregate(F.slice(pairs, i, F.lit(RUN)), start, step))
        return F.when(F.size(pairs) <= RUN, F.aggregate(pairs, start, step)["out"]).otherwise(_let(runs, moved))

    def moved(runs: Column) -> Column:
        begins = F.aggregate(runs, F.array(F.lit(0)), lambda sums, run: F.concat(sums, F.array(F.element_at(sums, -1) + run["at"])))
        move = lambda m, by: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["before"].alias("before"))
        return F.flatten(F.zip_with(runs, F.slice(begins, F.lit(1), F.size(runs)), lambda run, by: F.transform(run["out"], lambda m: move(m, by))))

    return _let(pairs, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every other digit is doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value, before) of one kind: code points, end exclusive, failing matches dropped."""
    mark, pattern = _PATTERNS[kind]
    plain = F.translate(text, _MARK, _TAKEN)
    ready = F.regexp_replace(plain, mark, _MARK) if mark else plain
    spans = F.filter(_found(ready, pattern), lambda m: _valid(kind, m["value"]))
    if kind not in _NEEDS:
        return spans
    return F.when(F.instr(text, _NEEDS[kind]) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string>>"))


def _patterns(before: Column, after: Column) -> Column:
    """The patterns around an identifier, from the text before and after it; null where there are too few words."""
    shaped = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\S*@\S*", "@"), "[0-9]+", "0")
    word = lambda parts, k: F.try_element_at(parts, F.lit(k))

    def around(parts: Column) -> Column:
        joined, one, two = word(parts, -1), F.nullif(word(parts, -2), F.lit("")), F.nullif(word(parts, -3), F.lit(""))
        follows = F.nullif(word(F.split(F.regexp_replace(shaped(after), r"^\s+", ""), r"\s+"), 1), F.lit(""))
        return F.array(F.concat(F.lit("joined "), F.nullif(joined, F.lit(""))), F.concat(F.lit("one "), one, F.lit(" "), joined), F.concat(F.lit("two "), two, F.lit(" "), one, F.lit(" "), joined), F.concat(F.lit("after "), joined, F.lit(" _ "), follows))

    return F.filter(_let(F.split(shaped(before), r"\s+"), around), lambda p: p.isNotNull())


def _with_context(spans: Column, tail: Column, reach: int) -> Column:
    """Spans (start, end, value, patterns) from those of ``_found``; ``tail`` is the text behind the last one."""

    def run(spans: Column) -> Column:
        n = F.size(spans)
        nothing = F.array(F.lit(None).cast("struct<start:int,end:int,value:string,before:string>"))
        earlier = F.concat(nothing, F.slice(spans, F.lit(1), F.greatest(n - 1, F.lit(0))))
        after = F.concat(F.transform(F.slice(spans, F.lit(2), n), lambda s: F.left(s["before"], F.lit(reach))), F.array(F.left(tail, F.lit(reach))))
        both = F.zip_with(spans, earlier, lambda s, e: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.right(F.concat(F.coalesce(F.right(e["before"], F.lit(reach)), F.lit("")), F.coalesce(e["value"], F.lit("")), s["before"]), F.lit(reach)).alias("before")))
        return F.zip_with(both, after, lambda s, a: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _patterns(s["before"], a).alias("patterns")))

    return F.when(F.size(spans) > 0, _let(spans, run)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,patterns:array<string>>>"))


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def identifiers(found: DataFrame) -> DataFrame:
    """Columns row, start, end, value, patterns, seed: base entities (seed 1, token false) and the tokens outside them."""
    base = F.concat(*(F.transform(kind, lambda s, k=kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(f"{k} "), s["value"]).alias("value"), s["patterns"].alias("patterns"), F.lit(False).alias("token"))) for kind in KINDS))
    tokens = F.transform("tokens", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["patterns"].alias("patterns"), F.lit(True).alias("token")))
    rows = found.select("row", F.explode(F.concat(base, tokens)).alias("o")).select("row", "o.*")
    # A token overlaps a base span if one that begins before it ends in it or later, or one begins inside it.
    ahead, behind = Window.partitionBy("row").orderBy("start", "token"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("token"))
    until_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.max(F.when(~F.col("token"), F.col("end"))).over(until_here(ahead))
    begins = F.min(F.when(~F.col("token"), F.col("start"))).over(until_here(behind))
    rows = rows.withColumns({"ends": ends, "begins": begins})
    rows = rows.where(~F.col("token") | ((F.coalesce("ends", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end"))))
    literal = F.col("value").rlike(_LITERAL)
    known = ~F.col("token") | F.col("value").rlike("^(?:" + "|".join(SECRET_FORMS) + ")$") | (literal & F.exists("patterns", lambda p: p.rlike(_LED)))
    return rows.select("row", "start", "end", "value", "patterns", "token", F.when(known, 1.0).when(literal, 0.5).otherwise(0.0).alias("seed"))


def pattern_scores(edges: DataFrame, rounds: int, support: int) -> DataFrame:
    """Columns pattern, score after the last round, from distinct edges (pattern, value, seed)."""
    # One pattern may have a large share of the instances, and one instance of the patterns: both joins are salted.
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(_SALTS)).cast("int")
    scored, patterns = edges, None
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.avg("seed").alias("score"), F.count_if(F.col("seed") >= 0.5).alias("known")).where(F.col("known") >= support).select("pattern", "score")
        if k == rounds - 1:
            break
        reached = edges.withColumn("salt", salt("value")).join(spread(patterns), ["pattern", "salt"], "left")
        instances = reached.groupBy("value").agg(F.max("seed").alias("own"), F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999999)))).alias("missed"))
        instances = instances.select("value", F.greatest("own", 1 - F.exp("missed")).alias("seed")).where("seed > 0")
        scored = edges.select("pattern", "value", salt("pattern").alias("salt")).join(spread(instances), ["value", "salt"], "left").select("pattern", "value", F.coalesce("seed", F.lit(0.0)).alias("seed"))
    return patterns


def _discovered(found: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """Columns row, other: the spans that confident patterns add."""
    rows = materialise(identifiers(found), "identifiers")
    by_pattern = rows.select("row", "start", "end", "value", "token", "seed", F.explode_outer("patterns").alias("pattern"))
    edges = materialise(by_pattern.where("pattern IS NOT NULL").groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    certain = edges.groupBy("pattern").agg(F.count_if(F.col("seed") >= 1).alias("certain")).where(F.col("certain") >= support)
    good = pattern_scores(edges, rounds, support).where((F.col("score") >= confidence) & F.col("pattern").rlike(_NAMES)).join(certain, "pattern")
    good = materialise(good.select("pattern"), "patterns")
    discard(edges)
    salt = F.pmod(F.xxhash64("value"), F.lit(_SALTS)).cast("int")
    spread = good.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    hits = by_pattern.where("token").withColumn("salt", salt).join(spread, ["pattern", "salt"], "left_semi")
    return hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("other"))


def find_pii(docs: DataFrame, rounds: int = 2, support: int = 5, confidence: float = 0.6, min_token: int = 6, reach: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, email, ip, card, phone and other: arrays of (start, end), a row per document.

    Null or empty text: no spans. Where kinds overlap each has its span; added
    ones overlap no base span and have ``min_token`` characters or more. Patterns
    are taken from ``reach`` characters on either side, two matches back at most. A
    null id comes back as null. Every row, also of a null or repeated id, gets the
    spans of its own text. An empty table gives an empty table; other columns are
    not read.
    """
    text = F.col("text")
    # Written once with the spans, so that it is the same wherever the table is read.
    row = F.monotonically_increasing_id().alias("row")
    tokens = _with_context(_found(text, _TOKEN), F.element_at(F.split(text, _TOKEN, -1), -1), reach)
    spans = (_with_context(base_spans(text, k), F.lit(""), reach).alias(k) for k in KINDS)
    found = id_and_text(docs, id_col, text_col).select("doc_id", *spans, F.filter(tokens, lambda t: t["end"] - t["start"] >= min_token).alias("tokens"), row)
    found = materialise(found, "spans")
    added = _discovered(found, rounds, support, confidence)
    bare = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    out = found.select("row", "doc_id", *(bare(k).alias(k) for k in KINDS)).join(added, "row", "left")
    return out.select(outer_id(), *KINDS, F.coalesce("other", F.array().cast("array<struct<start:int,end:int>>")).alias("other"))


def pii_report(spans: DataFrame) -> DataFrame:
    """Counts and joined spans for each row of ``find_pii``."""
    base = F.concat(*(_written(k, F.col(k)) for k in KINDS))
    return spans.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written("other", F.col("other"))), ",").alias("spans"), F.size("other").cast("long").alias("n_other"),
        sum((F.size(k) for k in ("other", *KINDS)), F.lit(0)).cast("long").alias("n_spans"),
    )
