"""Line dedup by log templates: a fixed-depth tree generalises lines, recurring ones go."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, stored

#: A variable field: a word with a digit or an at sign.  Looks behind, so a long word is read once.
FIELD = r"(?<![^ \t\r])[^ \t\r0-9@]*+[0-9@][^ \t\r]*+"
GAP = r"[ \t\r]+"
STAR = "<*>"


def parsed(lines: DataFrame, line: str, depth: int, groups: int) -> DataFrame:
    """Adds n_tokens, n_fixed, and the line's place in the tree: `leaf` (number of tokens and the
    first `depth` of them), `template` (all tokens, fields generalised) and `parts`, a hash of
    each of `groups` runs of tokens."""
    masked = F.when(F.col(line).rlike("[0-9@]"), F.regexp_replace(line, FIELD, STAR)).otherwise(
        F.col(line)
    )
    tokens = F.array_remove(F.split(masked, GAP), "")
    # as a row of its own, an array is made once, however often it is looked at
    out = lines.select(*lines.columns, F.explode_outer(F.array(tokens)).alias("_tokens"))
    out = out.withColumn("n_tokens", F.size("_tokens"))
    n, t = F.col("n_tokens"), F.col("_tokens")

    def run(g: int) -> Column:
        begin, end = F.floor(n * g / groups), F.floor(n * (g + 1) / groups)
        return F.hash(F.slice(t, (begin + 1).cast("int"), (end - begin).cast("int")))

    return out.select(
        *lines.columns,
        "n_tokens",
        F.size(F.array_remove(t, STAR)).alias("n_fixed"),
        F.xxhash64(n, F.slice(t, 1, depth)).alias("leaf"),
        F.struct(F.xxhash64(t), F.xxhash64(F.lit(1), t)).alias("template"),
        F.when(n >= groups, F.array(*[run(g) for g in range(groups)])).alias("parts"),
    )


def families(groups: int, alike: int) -> Column:
    """The keys of a template: its leaf with each choice of `groups - alike` runs left out."""
    masks = [
        F.xxhash64(F.lit(i), "leaf", *[F.col("parts")[g] for g in range(groups) if g not in out])
        for i, out in enumerate(combinations(range(groups), groups - alike))
    ]
    return F.array(*masks)


def varied(
    lines: DataFrame, seen: DataFrame, leaves: DataFrame, min_docs: int, groups: int, alike: int
) -> DataFrame:
    """(template, docs, first): templates of fewer than `min_docs` documents with a key that so
    many documents share, whatever stands for their leaf.

    Each such template has a handful of rows, so a document with several variants counts once.
    """
    key = families(groups, alike)
    inside = join_hot(seen, leaves.select("leaf"), "leaf", leaves.select("leaf", "n"))
    inside = stored(inside, "varied")
    rare = inside.where(F.col("docs") < min_docs)
    keys = rare.select("template", F.explode(key).alias("key"))
    rows = join_hot(
        lines.select("template", "doc_id", "version", "line"),
        rare.select("template", "leaf", "parts"),
        "template",
        seen.select("template", F.col("docs").alias("n")),
    )
    few = (
        rows.select("doc_id", "version", "line", F.explode(key).alias("key"))
        .groupBy("key")
        .agg(
            F.count_distinct(F.struct("doc_id", "version")).alias("docs"),
            F.min(F.struct("doc_id", "line")).alias("first"),
        )
    )
    many = (
        inside.where(F.col("docs") >= min_docs)
        .select("docs", "first", F.explode(key).alias("key"))
        .groupBy("key")
        .agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
    )
    shared = (
        few.unionByName(many)
        .groupBy("key")
        .agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
        .where(F.col("docs") >= min_docs)
    )
    shared = stored(shared, "families")
    found = join_hot(keys, shared, "key", shared.select("key", F.col("docs").alias("n")))
    return found.groupBy("template").agg(F.max("docs").alias("docs"), F.min("first").alias("first"))


def recurring(lines: DataFrame, min_docs: int, groups: int, alike: int) -> DataFrame:
    """(template, docs, first_doc): templates of at least `min_docs` documents.

    A leaf's most frequent template stands for it.  Templates that agree with it in `alike` of
    `groups` runs of tokens are one with it, the rest being variable fields, so their documents
    count together.  So are those of every other family in the leaf: templates that agree with
    each other in the same `alike` runs.
    """
    seen = lines.groupBy("leaf", "template").agg(
        F.count_distinct(F.struct("doc_id", "version")).alias("docs"),  # a null id counts
        F.min(F.struct("doc_id", "line")).alias("first"),
        F.first("parts").alias("parts"),
    )
    seen = stored(seen, "templates")
    leaves = (
        seen.groupBy("leaf")
        .agg(
            F.count("*").alias("n"),
            F.sum("docs").alias("all_docs"),
            F.min(
                F.struct((-F.col("docs")).alias("rank"), "first", "template", "parts")
            ).alias("head"),
        )
        .where((F.col("n") > 1) & (F.col("all_docs") >= min_docs))
        .where(F.col("head.parts").isNotNull())
    )
    leaves = stored(leaves, "leaves")
    variants = varied(lines, seen, leaves, min_docs, groups, alike)
    members = join_hot(
        seen.where(F.col("parts").isNotNull()),
        leaves.select("leaf", "head"),
        "leaf",
        leaves.select("leaf", "n"),
    )
    agree = F.size(
        F.filter(F.zip_with("parts", "head.parts", lambda a, b: a == b), lambda same: same)
    )
    members = members.where(agree >= alike)
    total = members.groupBy("leaf").agg(
        F.sum("docs").alias("docs"), F.min("first").alias("first")
    )
    merged = join_hot(
        members.select("leaf", "template"),
        total.where(F.col("docs") >= min_docs),
        "leaf",
        leaves.select("leaf", "n"),
    )
    alone = seen.where(F.col("docs") >= min_docs).select("template", "docs", "first")
    return (
        merged.select("template", "docs", "first")
        .unionByName(alone)
        .unionByName(variants)
        .groupBy("template")
        .agg(F.max("docs").alias("docs"), F.min("first")["doc_id"].alias("first_doc"))
    )


def mark_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 3,
    min_tokens: int = 3,
    depth: int = 3,
    groups: int = 8,
    alike: int = 6,
    copy_share: float = 0.8,
) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): each document without recurring lines.

    Lines are parsed into a tree of fixed depth by token count and leading tokens; words with
    digits and positions that vary within a leaf are variable fields.  A template found in
    `min_docs` documents is boilerplate: its lines are dropped, but for the document with the
    smallest id that has it, so that no content is lost.  A document that has over `copy_share` of
    its words in lines of one and the same earlier document is a copy of that one as a whole: it is
    left to document dedup, unchanged.

    Lines of under `min_tokens` words, or of mostly variable fields, stay.  Equal rows are one
    document; a null id sorts first; a null text stays null, an empty one empty, both without
    lines to drop.  All columns are kept in `row`, whatever their names.  Spark functions only.
    """
    version = F.xxhash64(F.col(text))
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        version.alias("version"),
        F.posexplode_outer(F.split(F.col(text), "\n")).alias("line", "words"),
    ).where(F.col("words").isNotNull())
    tree = parsed(split, "words", depth, groups).drop("words")
    # stored before the filter: under it Spark would cut every line into words several times
    able = (F.col("n_tokens") >= min_tokens) & (F.col("n_fixed") * 2 >= F.col("n_tokens"))
    lines = stored(tree, "lines").where(able).drop("n_fixed")
    # nothing recurs in a leaf of too few lines, and few leaves have enough
    full = lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    full = stored(full, "full-leaves")
    able = stored(join_hot(lines, full.select("leaf"), "leaf", full), "leaf-lines")
    common = stored(recurring(able, min_docs, groups, alike), "recurring")
    hits = join_hot(
        able.select("doc_id", "version", "line", "n_tokens", "template"),
        common.select("template", "first_doc"),
        "template",
        common.select("template", F.col("docs").alias("n")),
    ).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    # equal rows have equal lines: each is counted once
    by_first = (
        hits.select("doc_id", "version", "first_doc", "line", "n_tokens")
        .groupBy("doc_id", "version", "first_doc")
        .agg(F.collect_set(F.struct("line", "n_tokens")).alias("part"))
    )
    shared = F.aggregate("part", F.lit(0), lambda s, x: s + x["n_tokens"])
    lost = by_first.groupBy("doc_id", "version").agg(
        F.flatten(F.collect_list("part.line")).alias("lost"), F.max(shared).alias("shared")
    )
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("_id"), version.alias("_version")
    )
    lost = lost.select(
        F.col("doc_id").alias("_lost_id"), F.col("version").alias("_lost_version"), "lost", "shared"
    )
    both = keyed.join(
        lost,
        F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_version") == F.col("_lost_version")),
        "left",
    )
    body = F.col("row").getField(text)
    n_words = F.size(F.array_remove(F.split(body, r"[ \t\r\n]+"), ""))
    drop = F.coalesce(
        F.when(F.col("shared") <= n_words * copy_share, F.col("lost")), F.array().cast("array<int>")
    )
    pieces = F.split(body, "\n")
    kept = F.array_join(
        F.filter(pieces, lambda x, i: ~F.array_contains(F.col("_drop"), i.cast("int"))), "\n"
    )
    return both.withColumn("_drop", drop).select(
        "row",
        F.when(F.size("_drop") == 0, body).otherwise(kept).alias("kept_text"),
        F.coalesce(F.size(pieces), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size("_drop").cast("bigint").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """Documents with the recurring lines taken out of their texts; other columns unchanged."""
    name = options.get("text", "text")
    marked = mark_lines(docs, **options)
    return marked.select(
        *[
            (F.col("kept_text") if c == name else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_lines(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("text")
    )


OP5_SQL = """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS words,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents),
cut AS (
  SELECT doc_id, text, line, list_transform(
      list_filter(string_split_regex(words, '[ \t\r]+'), lambda t: t <> ''),
      lambda t: CASE WHEN regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END) AS t
  FROM raw),
lines AS (
  SELECT doc_id, text, line, t, len(t) AS n, list_slice(t, 1, 3) AS lead,
         list_transform(range(0, 8), lambda g:
           list_slice(t, (len(t) * g) // 8 + 1, (len(t) * (g + 1)) // 8)) AS parts
  FROM cut WHERE len(t) >= 3 AND 2 * len(list_filter(t, lambda x: x <> '<*>')) >= len(t)),
seen AS (
  SELECT n, lead, t, any_value(parts) AS parts, count(DISTINCT (doc_id, text)) AS docs,
         min({'known': doc_id IS NOT NULL, 'd': doc_id, 'l': line}) AS first
  FROM lines GROUP BY n, lead, t),
heads AS (
  SELECT n, lead, parts AS head FROM seen
  WHERE n >= 8
  QUALIFY row_number() OVER (PARTITION BY n, lead ORDER BY docs DESC, first) = 1),
members AS (
  SELECT s.* FROM seen s JOIN heads h ON s.n = h.n AND s.lead = h.lead
  WHERE len(list_filter(range(1, 9), lambda g: s.parts[g] = h.head[g])) >= 6),
merged AS (
  SELECT n, lead, sum(docs) AS docs, min(first) AS first FROM members GROUP BY n, lead
  HAVING sum(docs) >= 3),
mixed AS (
  SELECT n, lead FROM seen WHERE n >= 8 GROUP BY n, lead HAVING count(*) > 1 AND sum(docs) >= 3),
outs AS (SELECT a.g AS i, b.g AS j FROM range(1, 9) a(g), range(1, 9) b(g) WHERE a.g < b.g),
kin AS (
  SELECT s.n, s.lead, s.t, s.docs, s.first, i, j,
         list_transform(list_filter(range(1, 9), lambda g: g <> i AND g <> j), lambda g: parts[g]) AS rest
  FROM seen s JOIN mixed USING (n, lead), outs),
kin_docs AS (
  SELECT n, lead, i, j, rest, sum(docs) AS docs, min(first) AS first FROM (
    SELECT k.n, k.lead, i, j, rest, count(DISTINCT (l.doc_id, l.text)) AS docs, min(k.first) AS first
    FROM kin k JOIN lines l ON l.t = k.t WHERE k.docs < 3 GROUP BY ALL
    UNION ALL
    SELECT n, lead, i, j, rest, sum(docs), min(first) FROM kin WHERE docs >= 3 GROUP BY ALL)
  GROUP BY ALL HAVING sum(docs) >= 3),
common AS (
  SELECT t, min(first).d AS first_doc FROM (
    SELECT m.t, {'known': g.first.known, 'd': g.first.d} AS first
    FROM members m JOIN merged g ON m.n = g.n AND m.lead = g.lead
    UNION ALL
    SELECT t, {'known': first.known, 'd': first.d} FROM seen WHERE docs >= 3
    UNION ALL
    SELECT k.t, {'known': d.first.known, 'd': d.first.d} FROM kin k JOIN kin_docs d
      ON d.n = k.n AND d.lead = k.lead AND d.i = k.i AND d.j = k.j AND d.rest = k.rest
    WHERE k.docs < 3)
  GROUP BY t),
hits AS (
  SELECT DISTINCT l.doc_id, l.text, l.line, l.n, c.first_doc
  FROM lines l JOIN common c ON l.t = c.t AND l.doc_id IS DISTINCT FROM c.first_doc),
lost AS (
  SELECT doc_id, text, list_distinct(flatten(list(gone))) AS gone, max(words) AS shared FROM (
    SELECT doc_id, text, first_doc, list(line) AS gone, sum(n) AS words FROM hits GROUP BY ALL)
  GROUP BY doc_id, text),
final AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS pieces,
         CASE WHEN shared <= 0.8 * len(list_filter(
           string_split_regex(d.text, '[ \t\r\n]+'), lambda t: t <> '')) THEN gone END AS gone
  FROM documents d LEFT JOIN lost o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.text = o.text)
SELECT doc_id, coalesce(len(pieces), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
         list_filter(range(1, len(pieces) + 1), lambda i: NOT list_contains(gone, i - 1)),
         lambda i: pieces[i]), chr(10)), '') END AS text
FROM final
"""
