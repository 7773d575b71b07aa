"""Document fingerprints: Merkle trees over sections and paragraphs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from routeloom.llm.common import by_name, table, with_columns

#: A leaf is a piece of a paragraph: whole words, of at least LEAF_CHARS code points and at most LONGEST, so that pieces
#: after an inserted word soon start at the same words again.
LEAF_CHARS, LONGEST = 16, 48
LEAF = f"[^\\n]{{{LEAF_CHARS},{LONGEST}}}?(?:\\x20|\\z)|[^\\n]{{1,{LONGEST}}}"
#: Hex digits of a node's and of a leaf's digest that a fingerprint keeps; the root's are kept whole.
NODE_DIGITS, LEAF_DIGITS = 16, 8
LEAST = -(1 << 63)


def leaves(paragraph: Column) -> Column:
    """The digests of a paragraph's pieces."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit(f"({LEAF})"), 1), lambda p: F.sha2(p, 256))


def digest(parts: Column) -> Column:
    """An inner node's digest: that of its parts' digests in a row."""
    return F.sha2(F.array_join(parts, ""), 256)


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, leaves: array<string>>>>>: the sections of a text.

    An empty line ends a section, a line a paragraph, and a paragraph is cut into leaves. A leaf's digest is the SHA-256
    of its text, any other node's that of its parts' digests, so equal digests stand for equal texts.
    """

    def paragraph(line: Column) -> Column:
        own = leaves(line)
        return F.struct(digest(own).alias("digest"), own.alias("leaves"))

    def section(part: Column) -> Column:
        paragraphs = F.transform(F.split(part, "\n"), paragraph)
        return F.struct(
            digest(F.transform(paragraphs, lambda p: p["digest"])).alias("digest"), paragraphs.alias("paragraphs")
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)


def root(sections: Column) -> Column:
    """The digest of the sections' digests: texts are equal if their roots are."""
    return digest(F.transform(sections, lambda s: s["digest"]))


def written(sections: Column) -> Column:
    """A tree below its root as text: `section:paragraph,paragraph;section:...`, each node its short digest.

    A paragraph's is followed by those of its leaves; so branches are equal as text if they are equal as trees.
    """

    def paragraph(p: Column) -> Column:
        own = F.array_join(F.transform(p["leaves"], lambda d: F.substring(d, 1, LEAF_DIGITS)), "")
        return F.concat(F.substring(p["digest"], 1, NODE_DIGITS), own)

    def section(s: Column) -> Column:
        return F.concat(
            F.substring(s["digest"], 1, NODE_DIGITS), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), ",")
        )

    return F.array_join(F.transform(sections, section), ";")


def fingerprint(sections: Column) -> Column:
    return F.concat_ws(";", root(sections), written(sections))


def _sections(print_: Column) -> Column:
    return F.slice(F.split(print_, ";"), 2, 1 << 30)


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, NODE_DIGITS + 2, 1 << 30), ",")))


def _leaves(paragraphs: Column) -> Column:
    each = F.concat_ws("", F.transform(paragraphs, lambda p: F.substring(p, NODE_DIGITS + 1, 1 << 30)))
    return F.regexp_extract_all(each, F.lit(f"(.{{{LEAF_DIGITS}}})"), 1)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1, by descending both trees.

    Sections that both have are not opened, nor are paragraphs that the opened sections of both have; of what is left,
    distinct leaves are compared. It is 1 less the share of leaves that only one side has among all leaves, those that
    repeat within an opened branch counting once. Equal roots are alike by 1; texts of which one, or none, has leaves by 0.
    """
    below_a, below_b = _sections(a), _sections(b)
    parts_a, parts_b = (_paragraphs(F.array_except(x, y)) for x, y in ((below_a, below_b), (below_b, below_a)))
    left_a, left_b = (_leaves(F.array_except(x, y)) for x, y in ((parts_a, parts_b), (parts_b, parts_a)))
    apart = F.size(F.array_except(left_a, left_b)) + F.size(F.array_except(left_b, left_a))

    def count(sections: Column) -> Column:
        return F.size(_leaves(_paragraphs(sections)))

    total = count(below_a) + count(below_b)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(
        1 - apart / total
    )


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with tree (sections, their paragraphs and leaves), root and fingerprint (the root and the written tree).

    A null text counts as empty; equal texts, repeated rows included, have equal trees; columns of these names are
    replaced; an empty table gives an empty result.
    """
    treed = with_columns(docs, {"tree": tree(F.col(text))})
    return with_columns(treed, {"root": root(F.col("tree")), "fingerprint": fingerprint(F.col("tree"))})


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: the places (from 0) at which two trees' branches differ.

    Only sections of different digests are opened, and only their paragraphs of different digests are named; a place
    that one tree lacks differs.
    """

    def spots(x: Column, y: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)

    def differs(x: Column, y: Column, k: Column) -> Column:
        return ~F.get(x, k)["digest"].eqNullSafe(F.get(y, k)["digest"])

    def inside(s: Column) -> Column:
        none = F.filter(F.get(a, F.lit(0))["paragraphs"], lambda p: F.lit(False))
        x, y = (F.coalesce(F.get(t, s)["paragraphs"], none) for t in (a, b))
        return F.transform(
            F.filter(spots(x, y), lambda p: differs(x, y, p)),
            lambda p: F.struct(s.alias("section"), p.alias("paragraph")),
        )

    return F.flatten(F.transform(F.filter(spots(a, b), lambda s: differs(a, b, s)), inside))


def edits(pairs: DataFrame, a: str = "tree_a", b: str = "tree_b") -> DataFrame:
    """`pairs` of trees with edits, the places at which their branches differ; see differing."""
    return with_columns(pairs, {"edits": differing(F.col(a), F.col(b))})


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with next_text, the text of the row of the next smaller key; after the last row comes the first.

    Rows lie in ranges of keys whose bounds are quantiles; each range also gets the first row of the next one, so the
    order needs no task that sees all rows. Equal keys go by text; a null key comes last, a null text counts as empty.
    """
    spark = docs.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    known = docs.select(number.alias("__number"))
    cuts = known.agg(
        F.percentile_approx("__number", [(k + 1) / (wanted + 1) for k in range(wanted)], 10 * wanted)
    ).first()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[step - 1 :: step]

    def above(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda v: v > x))

    def numbers(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")

    ranged = with_columns(docs, {"__number": number, text: F.coalesce(text, F.lit(""))})
    ranged = with_columns(ranged, {"__coarse": above(numbers(coarse), F.col("__number")) * step})
    ranged = with_columns(
        ranged,
        {
            "__range": F.col("__coarse") + above(
                F.slice(numbers(bounds), F.col("__coarse") + 1, step), F.col("__number")
            )
        },
    ).drop("__coarse")
    firsts = sorted((r[0], r[1]) for r in ranged.groupBy("__range").agg(F.max("__number")).collect())  # as many as ranges
    after = [(firsts[(k + 1) % len(firsts)][1], r) for k, (r, _) in enumerate(firsts)]
    guests = spark.createDataFrame(after, "__guest long, __to int")
    schema = F.struct(F.col(text), F.col("__number"))
    own = ranged.select(*by_name(docs.columns), "__range", F.lit(0).alias("__late"), schema.alias("__row"))
    extra = ranged.join(F.broadcast(guests), F.col("__number") == F.col("__guest")).select(
        *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns],
        F.col("__to").alias("__range"),
        F.lit(1).alias("__late"),
        schema.alias("__row"),
    )
    both = own.unionByName(extra)
    order = W.partitionBy("__range").orderBy("__late", F.desc(F.col("__row")["__number"]), F.col("__row")[text])
    led = both.withColumn("next_text", F.lead(F.col("__row")[text]).over(order)).where("__late = 0")
    return with_columns(led, {text: F.col("__row")[text]}).drop("__range", "__late", "__row")


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_columns(
        docs,
        {
            "n_chars": n.cast("long"),
            "edited": F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)),
        },
    )
    treed = with_columns(
        edited, {"own": tree(F.col("text")), "after": tree(F.col("edited")), "other": tree(F.col("next_text"))}
    )
    # paragraphs are numbered through the whole text: one per line
    named = with_columns(treed, {c: fingerprint(F.col(t)) for c, t in (("f", "own"), ("g", "after"), ("h", "other"))})
    return named.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("f").alias("fingerprint"), F.col("g").alias("edited_fingerprint"),
        F.round(likeness(F.col("f"), F.col("g")), 9).alias("near_edited"),
        F.round(likeness(F.col("f"), F.col("h")), 9).alias("near_next"),
        F.array_join(
            F.transform(differing(F.col("own"), F.col("after")), lambda e: F.concat_ws(".", e["section"], e["paragraph"])), ","
        ).alias("edits"),
    )


def _leaves_sql(line: str) -> str:
    return f"list_transform(regexp_extract_all({line}, '{LEAF}'), lambda m: sha256(m))"


def _tree_sql(text: str) -> str:
    """A list of sections, each a list of paragraphs, each a list of its leaves' digests."""
    return (
        f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s:"
        f" list_transform(string_split(s, chr(10)), lambda p: {_leaves_sql('p')}))"
    )


PARAGRAPH_SQL = "sha256(array_to_string({p}, ''))"
SECTION_SQL = f"sha256(array_to_string(list_transform({{s}}, lambda q: {PARAGRAPH_SQL.format(p='q')}), ''))"


def _root_sql(t: str) -> str:
    return f"sha256(array_to_string(list_transform({t}, lambda r: {SECTION_SQL.format(s='r')}), ''))"


def _written_sql(t: str) -> str:
    """A list of sections as text."""
    own = f"array_to_string(list_transform(q, lambda d: substr(d, 1, {LEAF_DIGITS})), '')"
    paragraph = f"substr({PARAGRAPH_SQL.format(p='q')}, 1, {NODE_DIGITS}) || {own}"
    lines = f"array_to_string(list_transform(r, lambda q: {paragraph}), ',')"
    return f"list_transform({t}, lambda r: substr({SECTION_SQL.format(s='r')}, 1, {NODE_DIGITS}) || ':' || {lines})"


def _except_sql(x: str, y: str) -> str:
    return f"list_filter(list_distinct({x}), lambda v: NOT list_contains({y}, v))"


def _paragraphs_sql(x: str) -> str:
    return f"flatten(list_transform({x}, lambda r: string_split(substr(r, {NODE_DIGITS + 2}), ',')))"


def _digests_sql(x: str) -> str:
    return f"regexp_extract_all(array_to_string(list_transform({x}, lambda q: substr(q, {NODE_DIGITS + 1})), ''), '.{{{LEAF_DIGITS}}}')"


def _edits_sql(x: str, y: str) -> str:
    section, paragraph = SECTION_SQL.format, PARAGRAPH_SQL.format
    spot = f"{paragraph(p=f'{x}[i][j]')} IS DISTINCT FROM {paragraph(p=f'{y}[i][j]')}"
    inside = f"list_transform(list_filter(range(1, greatest(coalesce(len({x}[i]), 0), coalesce(len({y}[i]), 0)) + 1), lambda j: {spot}), lambda j: (i - 1) || '.' || (j - 1))"
    spots = f"list_filter(range(1, greatest(len({x}), len({y})) + 1), lambda i: {section(s=f'{x}[i]')} IS DISTINCT FROM {section(s=f'{y}[i]')})"
    return f"array_to_string(flatten(list_transform({spots}, lambda i: {inside})), ',')"


OP3_SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, COALESCE(LEAD(text) OVER (ORDER BY doc_id DESC, text), FIRST_VALUE(text) OVER (ORDER BY doc_id DESC, text)) AS next_text FROM d),
e AS (
  SELECT *, LENGTH(text) AS n_chars, substr(text, 1, LENGTH(text) - LENGTH(text) // 2) || substr(next_text, 1, LENGTH(text) // 2) AS edited FROM n),
t AS (SELECT *, {_tree_sql("text")} AS t0, {_tree_sql("edited")} AS t1, {_tree_sql("next_text")} AS t2 FROM e),
w AS (SELECT *, {_root_sql("t0")} AS r0, {_root_sql("t1")} AS r1, {_root_sql("t2")} AS r2,
        {_written_sql("t0")} AS s0, {_written_sql("t1")} AS s1, {_written_sql("t2")} AS s2 FROM t),
p AS (SELECT *, {_paragraphs_sql(_except_sql("s0", "s1"))} AS a1, {_paragraphs_sql(_except_sql("s1", "s0"))} AS b1,
        {_paragraphs_sql(_except_sql("s0", "s2"))} AS a2, {_paragraphs_sql(_except_sql("s2", "s0"))} AS b2,
        len({_digests_sql(_paragraphs_sql("s0"))}) AS n0, len({_digests_sql(_paragraphs_sql("s1"))}) AS n1, len({_digests_sql(_paragraphs_sql("s2"))}) AS n2 FROM w),
l AS (SELECT *, {_digests_sql(_except_sql("a1", "b1"))} AS c1, {_digests_sql(_except_sql("b1", "a1"))} AS d1,
        {_digests_sql(_except_sql("a2", "b2"))} AS c2, {_digests_sql(_except_sql("b2", "a2"))} AS d2 FROM p)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, r0 || ';' || array_to_string(s0, ';') AS fingerprint,
       r1 || ';' || array_to_string(s1, ';') AS edited_fingerprint,
       ROUND(CASE WHEN r0 = r1 THEN 1.0 WHEN n0 + n1 = 0 THEN 0.0 ELSE 1 - (len({_except_sql("c1", "d1")}) + len({_except_sql("d1", "c1")})) / (n0 + n1) END, 9) AS near_edited,
       ROUND(CASE WHEN r0 = r2 THEN 1.0 WHEN n0 + n2 = 0 THEN 0.0 ELSE 1 - (len({_except_sql("c2", "d2")}) + len({_except_sql("d2", "c2")})) / (n0 + n2) END, 9) AS near_next,
       {_edits_sql("t0", "t1")} AS edits
FROM l
"""
