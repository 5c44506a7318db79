"""Secret scans (operator 7): multipart credential linking. DataFrame functions only.

Base kinds are leftmost non-overlapping matches. A weak kind is reported only where complementary parts meet it: an
interval join over the parts of one document, within a scope of ``SCOPE`` code points. All parts of a document stay in
its row, so the join is a filter over arrays and nothing is shuffled.

* ``secret``: a token of 40 letters, digits, ``/`` or ``+`` with a capital, a small letter and a digit; weak alone (a
  digest or an encoded blob looks alike). Reported if an access identifier lies within the scope.
* ``endpoint``: a URL; harmless alone. Reported if within its scope lie both an access identifier and a value that goes
  with it (an assignment, a hex run, or a reported ``secret``).

Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import let

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SECRET = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[^\s"'<>]{4,}"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
SCOPE = 400
#: Matches that are put in place together, and steps of a binary search among a text's matches.
BLOCK, STEPS = 256, 26
#: What a redacting stage leaves in place of a span.
MASK = "[secret]"


def in_blocks(n: Column, made) -> Column:
    """``made(lo, hi)`` for each ``BLOCK`` of 0..n-1: folds that grow an array stay short, however many matches there are."""
    last = F.floor((n - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: made(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1))


def before_each(values: Column, start: Column, both) -> Column:
    """For each of ``values`` (one for a block) what ``both`` makes of ``start`` and all values before it."""
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct(both(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def spans_of(text: Column, pattern: str, keep=None) -> Column:
    """Array of (s, e) of the leftmost non-overlapping matches that ``keep`` (of the matched string) accepts.

    The pieces between the matches and the matches themselves, in turn, make up the text; their lengths give positions,
    first inside each block of matches, then by the blocks' lengths.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")

    def build(parts: Column, found: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(parts, i))
            m = F.get(found, i)
            return let(
                F.struct(s.alias("s"), (s + F.length(m)).alias("e")),
                lambda span: F.struct(span["e"].alias("at"), F.when(keep(m) if keep else F.lit(True), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")),
            )

        def placed(blocks: Column) -> Column:
            offsets = before_each(F.transform(blocks, lambda x: x["at"]), F.lit(0), lambda at, size: at + size)
            moved = lambda x, by: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"))
            return let(offsets, lambda o: F.flatten(F.transform(blocks, lambda x, i: F.transform(x["out"], lambda y: moved(y, F.get(o, i))))))

        return let(in_blocks(F.size(found), lambda lo, hi: F.aggregate(F.sequence(lo, hi), zero, step)), placed)

    hit = let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: build(parts, found)))
    return F.when(text.rlike(pattern), hit).otherwise(none)


def long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def mixed(match: Column) -> Column:
    return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")


def first_from(others: Column, limit: Column) -> Column:
    """The first of ``others`` (of one kind, so in order and apart) that ends at ``limit`` or later, by binary search; null if none does."""

    def halve(acc: Column, b: Column) -> Column:
        return let(acc + F.call_function("shiftleft", F.lit(1), b), lambda d: F.when((d <= F.size(others)) & (F.get(others, d - 1)["e"] < limit), d).otherwise(acc))

    return F.get(others, F.aggregate(F.sequence(F.lit(STEPS), F.lit(0), F.lit(-1)), F.lit(0), halve))


def near(span: Column, others: Column, scope: int) -> Column:
    return (F.size(others) > 0) & F.coalesce(first_from(others, span["s"] - scope)["s"] <= span["e"] + scope, F.lit(False))


def outside(span: Column, others: Column) -> Column:
    return (F.size(others) == 0) | F.coalesce(first_from(others, span["s"] + 1)["s"] >= span["e"], F.lit(True))


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``secret_spans``: an array of (s, e, kind index in ``KINDS``) by start, then kind.

    A null or empty text has no spans. Other columns stay as they are; rows are never dropped; equal rows get equal
    spans; a column that is named ``secret_spans`` is replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = {"assign": spans_of(t, ASSIGN, long_value), "access": spans_of(t, ACCESS), "hex": spans_of(t, HEX)}
    # The weak kinds are looked for only in documents that have an access identifier.
    has = t.rlike(ACCESS)
    none = F.array().cast("array<struct<s:int,e:int>>")
    weak = {"secret": F.when(has, spans_of(t, SECRET, mixed)).otherwise(none), "endpoint": F.when(has, spans_of(t, ENDPOINT)).otherwise(none)}

    def link(p: Column) -> Column:
        secret = F.filter(p["secret"], lambda x: near(x, p["access"], scope) & outside(x, p["assign"]) & outside(x, p["access"]))
        return let(secret, lambda found: linked(p, found))

    def linked(p: Column, secret: Column) -> Column:
        valued = lambda x: near(x, p["assign"], scope) | near(x, p["hex"], scope) | near(x, secret, scope)
        endpoint = F.filter(p["endpoint"], lambda x: near(x, p["access"], scope) & valued(x))
        groups = [p["assign"], p["access"], p["hex"], secret, endpoint]
        named = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
        return F.array_sort(F.concat(*[F.transform(g, named(k)) for k, g in enumerate(groups)]))

    parts = F.struct(*[v.alias(k) for k, v in {**base, **weak}.items()])
    return docs.withColumn("secret_spans", let(parts, link))


def listed(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of ``secret_spans`` by ``MASK`` (overlapping spans by one) and drops that column; a text without spans is unchanged."""
    t = F.col(f"`{text}`")

    spans = F.col("secret_spans")

    def cut(ends: Column) -> Column:
        # ends: for each block of spans where the text before it is done with; the last one is the text's end.
        def block(i: Column) -> Column:
            at = F.get(ends, i)
            part = F.substring(t, at + 1, F.get(ends, i + 1) - at)
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

            def whole(text_: Column) -> Column:
                def step(acc: Column, x: Column) -> Column:
                    put = F.when(x["s"] - at >= acc["at"], F.concat(acc["out"], F.array(F.substring(text_, acc["at"] + 1, x["s"] - at - acc["at"]), F.lit(MASK)))).otherwise(acc["out"])
                    return F.struct(F.greatest(acc["at"], x["e"] - at).alias("at"), put.alias("out"))

                made = F.aggregate(F.slice(spans, i * BLOCK + 1, BLOCK), zero, step)
                return let(made, lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text_, r["at"] + 1, F.length(text_))))

            return let(part, whole)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ends) - 2), block), "")

    furthest = in_blocks(F.size(spans), lambda lo, hi: F.array_max(F.transform(F.slice(spans, lo + 1, hi - lo + 1), lambda x: x["e"])))
    ends = let(furthest, lambda f: F.concat(before_each(f, F.lit(0), lambda at, e: F.greatest(at, e)), F.array(F.length(t))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, let(ends, cut)).otherwise(t)).drop("secret_spans")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("secret_spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"),
    )


QUERIES = {"op7_secret_scans": op7_secret_scans}
