"""Full-text search, HTML extraction, sentences, chunks and hash vectors.

Documents are searched with their first line as the title; pages supply the HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import words
from tidemark.operators import fulltext as ft
from tidemark.operators.blocks import build_blocks, read_blocks, search_topk, write_blocks
from tidemark.operators.chunking import chunk_documents, sentences
from tidemark.operators.embedding import (
    hash_embed,
    hash_embedding,
    mixed_models,
    refresh_chunks,
)
from tidemark.operators.html import extract_text
from tidemark.operators.nextword import build_pairs, phrase_match, write_pairs
from tidemark.operators.stem import stem_index
from tidemark.operators.ranking import spread_rows
from tidemark.plans import standin as s
from tidemark.schemas import CHUNKS
from tidemark.sources.clustered import write_clustered
from tidemark.sources.shared import shared_path, stored


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as titled texts."""
    return s.document_texts(spark, d)


def index(spark: SparkSession, d: str, *terms: str) -> DataFrame:
    """The index of all documents, or only its rows of some words."""
    if terms:
        return ft.build_index(texts(spark, d), terms=terms)
    return ft.build_index(spread_rows(texts(spark, d), "posting_id"))


#: Words of the documents with place and weight, in SQL.
HITS_SQL = """
  docs AS (
    SELECT doc_id AS posting_id, string_split(text, chr(10))[1] AS title,
           substr(text, length(string_split(text, chr(10))[1]) + 2) AS body, * FROM documents),
  toks AS (
    SELECT posting_id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+') AS tt,
           regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+') AS bt FROM docs),
  hits AS (
    SELECT posting_id, unnest(tt) AS term, generate_subscripts(tt, 1) - 1 AS pos, 1.0::DOUBLE AS w
    FROM toks
    UNION ALL
    SELECT posting_id, unnest(bt), len(tt) + generate_subscripts(bt, 1) - 1, 0.4::DOUBLE FROM toks)
"""


def postings_df(spark: SparkSession, d: str) -> DataFrame:
    return ft.document_frequency(index(spark, d))


def occurrence_positions(spark: SparkSession, d: str) -> DataFrame:
    """Index rows with the positions as text."""
    return index(spark, d).select(
        "term", "posting_id", "field", F.array_join("positions", ",").alias("positions")
    )


def refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Index over English documents after the others arrive: equal to a full build."""
    # dealt out by document, so that neither build has to move its words to meet the changes
    docs = texts(spark, d).repartition("posting_id")
    english = F.col("lang") == "en"
    partial = ft.build_index(docs.where(english))
    out = ft.refresh_index(partial, docs, docs.where(~english))
    return ft.document_frequency(out)


def text_match_all(spark: SparkSession, d: str) -> DataFrame:
    return ft.text_match(index(spark, d, "the", "of", "and"), all_of=["the", "of", "and"])


def text_match_exclude(spark: SparkSession, d: str) -> DataFrame:
    return ft.text_match(index(spark, d, "the", "is", "for"), all_of=["the"], none_of=["is", "for"])


def text_match_any(spark: SparkSession, d: str) -> DataFrame:
    rows = index(spark, d, "und", "des", "los", "die")
    return ft.text_match(rows, any_of=["und", "des", "los"], none_of=["die"])


def text_match_absent(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d)
    rows = index(spark, d, "the", "de")
    return ft.text_match(rows, none_of=["the", "de"], universe=docs)


def text_match_phrase(spark: SparkSession, d: str) -> DataFrame:
    return ft.text_match(index(spark, d, "of", "the", "in"), phrases=[["of", "the"], ["in", "the"]])


#: Frequent English words of the documents.
FREQUENT = ("the", "of", "and", "in", "to", "is", "for")


def phrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The phrases of `text_match_phrase` from a stored pair index, without the places of a word."""
    path = shared_path(spark, "pairs")
    write_pairs(build_pairs(texts(spark, d), FREQUENT), path)
    pairs = spark.read.parquet(path)
    return phrase_match(pairs, None, [["of", "the"], ["in", "the"]], FREQUENT)


def text_rank(spark: SparkSession, d: str) -> DataFrame:
    queries = {"one": ["the"], "two": ["the", "of"], "three": ["and", "in", "is"], "de": ["la", "de"]}
    return ft.text_rank(index(spark, d, *sorted({w for ws in queries.values() for w in ws})), queries)


def _search_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as postings, their length in the roles of employer, salary and date."""
    return s.document_texts(spark, d).select(
        "posting_id",
        "title",
        F.col("n_chars").alias("employer_id"),
        F.col("n_chars").alias("salary_from_base"),
        (F.col("lang") == "en").alias("is_remote"),
        F.expr("timestampadd(MINUTE, n_chars, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("published_at"),
        F.col("body").alias("description"),
    )


def _search(postings: DataFrame, spark: SparkSession, d: str, **more) -> DataFrame:
    return ft.search_postings(
        postings,
        s.employers(spark, d),
        index(spark, d, "the", "of", "is"),
        "The, of!",
        none_of=["is"],
        stop_words=frozenset(),
        salary_min=200,
        remote_only=True,
        limit=40,
        **more,
    )


def search_text(spark: SparkSession, d: str) -> DataFrame:
    columns = ["posting_id", "employer_name", "salary_from_base", "published_at", "rank"]
    return _search(_search_postings(spark, d), spark, d, columns=columns)


def search_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same search; titles and descriptions come from a store by key ranges."""
    postings = _search_postings(spark, d)
    store = write_clustered(postings, shared_path(spark, "postings"), "posting_id", files=64)
    columns = ["posting_id", "employer_name", "title", "description", "rank"]
    return _search(postings.drop("title", "description"), spark, d, columns=columns, store=store)


BLOCK_QUERIES = {"one": ["the"], "two": ["the", "of"], "three": ["and", "in", "is"], "de": ["la", "de"]}


def search_topk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Five best documents of each query from a stored block index."""
    words_ = sorted({w for ws in BLOCK_QUERIES.values() for w in ws})
    path = shared_path(spark, "blocks")
    write_blocks(build_blocks(index(spark, d, *words_), block_docs=16), path)
    blocks, bounds = read_blocks(spark, path)
    best, _ = search_topk(blocks, bounds, ft.query_terms(spark, BLOCK_QUERIES), 5)
    return best


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary with stems: here the first five letters of each word."""
    return _stems(index(spark, d))


def _stems(rows: DataFrame) -> DataFrame:
    terms = rows.select("term").distinct()
    return terms.withColumn("stem", F.substring("term", 1, 5))


def stemmed_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words per stem in the stemmed index."""
    # the index is made once, for its words and for their places
    rows = stored(index(spark, d), "words")
    stemmed = stem_index(rows, _stems(rows))
    return ft.document_frequency(stemmed).select(
        F.col("term").alias("stem"), "documents", F.col("occurrences").alias("n_words")
    )


def page_text(spark: SparkSession, d: str) -> DataFrame:
    # one small file is one task; spread it for the parser
    pages = spread_rows(s.table(spark, d, "pages").select("page_id", "html"), "page_id")
    return extract_text(pages).select("page_id", "text")


def page_postings(spark: SparkSession, d: str) -> DataFrame:
    """Pages as postings with an HTML description."""
    pages = s.table(spark, d, "pages").select(
        F.col("page_id").alias("posting_id"), F.col("url").alias("title"), F.col("html").alias("description")
    )
    return spread_rows(pages, "posting_id")


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Second indexing run: English pages are done, German ones by another model."""
    pages = page_postings(spark, d)
    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], CHUNKS)
    english, german = (pages.where(F.col("title").contains(f"/{lang}/")) for lang in ("en", "de"))
    done, _ = refresh_chunks(english, empty, model="new", now=now)
    stale, _ = refresh_chunks(german, empty, model="old", now=now)
    return refresh_chunks(pages, done.unionByName(stale), model="new", now=now)


def indexing_counts(spark: SparkSession, d: str) -> DataFrame:
    _, counts = _indexed(spark, d)
    return counts.select("postings_processed", "chunks_written", "postings_skipped")


def indexed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after the run: whose chunks, with which text, by which model, and whether
    the vector of each is the one that its text has by itself."""
    table, _ = _indexed(spark, d)
    own = F.transform(hash_embedding(F.col("content")), lambda x: x.cast("float"))
    return table.select(
        F.col("posting_id").alias("page_id"), "chunk_index", "content", "char_len", "model_name",
        (F.col("embedding").cast("array<float>") == own).alias("own_vector"),
    )


def indexed_models(spark: SparkSession, d: str) -> DataFrame:
    """Postings per model after the run, and how many mix two."""
    table, _ = _indexed(spark, d)
    keys = table.select("posting_id", "model_name")
    return (
        keys.groupBy("model_name")
        .agg(F.count_distinct("posting_id").alias("postings"))
        .withColumn("mixed", mixed_models(keys).agg(F.count(F.lit(1))).scalar())
    )


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = s.table(spark, d, "documents").select("doc_id", "text")
    parts = F.posexplode_outer(sentences(F.col("text"))).alias("place", "sentence")
    return docs.select("doc_id", parts).where(F.col("place").isNotNull())


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = spread_rows(s.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return chunk_documents(docs, "doc_id", "text", 300, 60)


def titled_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = spread_rows(s.table(spark, d, "pages").select("page_id", "url", "html"), "page_id")
    text = extract_text(pages)
    return chunk_documents(text, "page_id", "text", title_col="url")


def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per document: chunk numbers have no gaps and no distinct word is lost or invented."""
    # by document alone: chunks are made once and shuffled once, each with its words in one row
    chunks = document_chunks(spark, d).where(F.col("doc_id").isNotNull()).repartition("doc_id")
    split = F.split("content", r"\s+")
    # the empty word stands for the chunk itself, so that one pass counts both
    marked = F.array_distinct(F.concat(F.array(F.lit("")), split))
    word = chunks.select("doc_id", "chunk_index", F.explode(marked).alias("word"))
    once = word.groupBy("doc_id", "word").agg(
        F.max("chunk_index").alias("last"), F.count(F.lit(1)).alias("chunks")
    )
    own = F.col("word") == ""
    counted = once.groupBy("doc_id").agg(
        F.count_if(~own).alias("distinct_words"),
        (F.max(F.when(own, F.col("last"))) + 1 == F.sum(F.when(own, F.col("chunks")))).alias("no_gaps"),
    )
    return counted.where(F.col("distinct_words") > 0)


def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = spread_rows(s.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return hash_embed(docs, "text").select("doc_id", "embedding")


def hash_norms(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a word has a unit vector, any other the zero vector."""
    square = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return hash_vectors(spark, d).select(
        "doc_id",
        F.round(F.sqrt(square), 4).alias("norm"),
        F.size("embedding").cast("long").alias("dim"),
    )


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(words(F.col("text"))).cast("long").alias("n_words")
    )


_ALL_TERMS = "sets AS (SELECT posting_id, list_distinct(tt || bt) AS ws FROM toks)"

_DF_SQL = f"""
WITH {HITS_SQL}
SELECT term, count(DISTINCT posting_id) AS documents, count(*) AS occurrences
FROM hits GROUP BY term"""


def _set_sql(condition: str) -> str:
    return f"WITH {HITS_SQL}, {_ALL_TERMS} SELECT posting_id FROM sets WHERE {condition}"


def rank_sql(name: str, terms: list[str]) -> str:
    """Rank of one query: covers found from their begin, looking ahead to the next places."""
    n = len(terms)
    ahead = ", ".join(
        f"min(pos) FILTER (WHERE term = '{t}') OVER ahead AS a{i}" for i, t in enumerate(terms)
    )
    back = ", ".join(
        f"arg_max(w, pos) FILTER (WHERE term = '{t}') OVER back AS w{i}" for i, t in enumerate(terms)
    )
    listed = ", ".join(f"'{t}'" for t in terms)
    last = "greatest(" + ", ".join(f"a{i}" for i in range(n)) + ")"
    known = " AND ".join(f"a{i} IS NOT NULL" for i in range(n))
    mean = "(" + " + ".join(f"w{i}" for i in range(n)) + f") / {n}"
    return f"""
  SELECT '{name}' AS query_id, c.posting_id,
         sum({mean} / (1 + (c.e - c.b + 1 - {n}))) AS rank
  FROM (SELECT posting_id, e, max(b) AS b FROM (
          SELECT posting_id, pos AS b, {last} AS e FROM (
            SELECT posting_id, pos, {ahead} FROM hits WHERE term IN ({listed})
            WINDOW ahead AS (PARTITION BY posting_id ORDER BY pos
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
          WHERE {known})
        GROUP BY posting_id, e) c
  JOIN (SELECT posting_id, pos, {back} FROM hits WHERE term IN ({listed})
        WINDOW back AS (PARTITION BY posting_id ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) k
    ON k.posting_id = c.posting_id AND k.pos = c.e
  GROUP BY c.posting_id"""


def _unescape_sql(text: str) -> str:
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{entity}', '{char}', 'g')"
    return text


#: Text of the pages: their tags and entities are few, so plain replacements do.  The one
#: closing tag inside a script string is data and is set aside first.
_PAGE_TEXT_SQL = f"""
WITH raw AS (SELECT page_id, replace(html, '"</p>"', '"' || chr(1) || '"') AS h FROM pages),
bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
    '<!--.*?-->|<![^>]*>', '', 'g'), '<li( [^>]*)?>', chr(10) || '— ', 'g'),
    '</?(p|div|br|li|ul|ol|h[1-6]|tr|table|blockquote|section|hr)( [^>]*)?/?>', chr(10), 'g'),
    '<[^>]*>', '', 'g') AS t FROM raw),
plain AS (SELECT page_id, replace(replace({_unescape_sql(_unescape_sql("t"))}, chr(1), '</p>'), chr(160), ' ') AS t
          FROM bare),
tidy AS (SELECT page_id, list_transform(string_split(t, chr(10)),
           lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS ls FROM plain)
SELECT page_id, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'),
                               '^\\s+|\\s+$', '', 'g') AS text
FROM tidy"""

def _sentences_sql(texts: str) -> str:
    """Sentences of a relation with `doc_id` and `text`."""
    return f"""
  cut AS (
    SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss
    FROM {texts}),
  sents AS (SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS place,
                   unnest(ss) AS sentence FROM cut)
"""


def _chunks_sql(texts: str, overlap: int, key: str) -> str:
    """Chunks of a query with `doc_id`, `text`, `prefix` and `budget`, walked by sentences.

    Lengths are running sums, so a stretch is measured by its ends; long sentences are first
    walked word by word into pieces that stand alone.
    """
    return f"""
WITH RECURSIVE texts AS ({texts}), {_sentences_sql("texts")},
  sized AS (SELECT s.*, budget FROM sents s JOIN texts USING (doc_id)),
  ws AS (SELECT doc_id, place, budget, list_filter(string_split(sentence, ' '), lambda x: x <> '') AS wl
         FROM sized WHERE length(sentence) > budget),
  words AS (SELECT doc_id, place, budget, unnest(wl) AS word, generate_subscripts(wl, 1) - 1 AS w FROM ws),
  ends AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id, place ORDER BY w) AS upto FROM words),
  pack(doc_id, place, w, base, upto, piece) AS (
    SELECT doc_id, place, w, 0::HUGEINT, upto, 0 FROM ends WHERE w = 0
    UNION ALL
    SELECT e.doc_id, e.place, e.w,
           CASE WHEN e.upto - 1 - p.base > e.budget THEN p.upto ELSE p.base END, e.upto,
           CASE WHEN e.upto - 1 - p.base > e.budget THEN p.piece + 1 ELSE p.piece END
    FROM pack p JOIN ends e ON e.doc_id = p.doc_id AND e.place = p.place AND e.w = p.w + 1),
  pieces AS (SELECT doc_id, place, piece, string_agg(word, ' ' ORDER BY w) AS txt
             FROM pack JOIN words USING (doc_id, place, w) GROUP BY doc_id, place, piece),
  units AS (
    SELECT doc_id, txt, alone, row_number() OVER (PARTITION BY doc_id ORDER BY place, piece) - 1 AS i
    FROM (SELECT doc_id, place, 0 AS piece, sentence AS txt, false AS alone FROM sized
          WHERE length(sentence) <= budget
          UNION ALL SELECT doc_id, place, piece, txt, true FROM pieces)),
  placed AS (SELECT *, length(txt) AS len,
               CAST(sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(txt) - 1 AS BIGINT) AS p
             FROM units),
  tails AS (SELECT placed.*, coalesce(max(i) OVER far, 0) AS tail, coalesce(max(p) OVER far, 0) AS tail_p,
                   max(i) OVER (PARTITION BY placed.doc_id) AS last, budget
            FROM placed JOIN texts ON texts.doc_id = placed.doc_id
            WINDOW far AS (PARTITION BY placed.doc_id ORDER BY p
                           RANGE BETWEEN UNBOUNDED PRECEDING AND {overlap} PRECEDING)),
  walk(doc_id, i, last, first, first_p, done_from, done_to) AS (
    SELECT DISTINCT doc_id, -1::BIGINT, last, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM tails
    UNION ALL
    SELECT t.doc_id, t.i, t.last,
           CASE WHEN t.alone THEN t.i + 1
                WHEN k.first < t.i AND t.p + t.len - k.first_p > t.budget THEN greatest(k.first, t.tail)
                ELSE k.first END,
           CASE WHEN t.alone THEN t.p + t.len + 1
                WHEN k.first < t.i AND t.p + t.len - k.first_p > t.budget THEN greatest(k.first_p, t.tail_p)
                ELSE k.first_p END,
           CASE WHEN k.first < t.i AND (t.alone OR t.p + t.len - k.first_p > t.budget) THEN k.first END,
           CASE WHEN k.first < t.i AND (t.alone OR t.p + t.len - k.first_p > t.budget) THEN t.i - 1 END
    FROM walk k JOIN tails t ON t.doc_id = k.doc_id AND t.i = k.i + 1),
  spans AS (
    SELECT doc_id, done_from AS a, done_to AS b FROM walk WHERE done_from IS NOT NULL
    UNION ALL SELECT doc_id, i, i FROM placed WHERE alone
    UNION ALL SELECT doc_id, first, i FROM walk WHERE i = last AND first <= i),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS n FROM spans),
  bodies AS (SELECT s.doc_id, s.n, string_agg(u.txt, ' ' ORDER BY u.i) AS body
             FROM numbered s JOIN units u ON u.doc_id = s.doc_id AND u.i BETWEEN s.a AND s.b
             GROUP BY s.doc_id, s.n)
SELECT doc_id AS {key}, CAST(n AS INTEGER) AS chunk_index, prefix || body AS content,
       CAST(length(prefix || body) AS INTEGER) AS char_len
FROM bodies JOIN texts USING (doc_id)"""


_TITLED_CHUNKS_SQL = _chunks_sql(
    f"""SELECT page_id AS doc_id, text, url || chr(10) AS prefix,
        greatest(900 - length(url) - 1, 1) AS budget
        FROM ({_PAGE_TEXT_SQL}) JOIN pages USING (page_id)""",
    150,
    "page_id",
)


def _search_sql(columns: str) -> str:
    return f"""
WITH {HITS_SQL}, {_ALL_TERMS}
SELECT d.posting_id, c_name AS employer_name, {columns}, round(r.rank, 9) AS rank
FROM (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(n_chars) AS published_at FROM docs) d
JOIN ({rank_sql("q", ["the", "of"])}) r USING (posting_id)
JOIN sets s USING (posting_id) LEFT JOIN customer ON c_custkey = n_chars
WHERE NOT list_contains(ws, 'is') AND n_chars >= 200 AND lang = 'en'
ORDER BY round(r.rank, 9) DESC, published_at DESC, d.posting_id LIMIT 40"""


QUERIES = {
    "postings_df": (postings_df, _DF_SQL),
    "index_refresh": (refreshed, _DF_SQL),
    "index_positions": (
        occurrence_positions,
        f"""
WITH {HITS_SQL}
SELECT term, posting_id, CASE WHEN w = 1.0 THEN 'A' ELSE 'B' END AS field,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM hits GROUP BY ALL""",
    ),
    "text_match_all": (
        text_match_all,
        _set_sql("list_has_all(ws, ['the', 'of', 'and'])"),
    ),
    "text_match_exclude": (
        text_match_exclude,
        _set_sql("list_contains(ws, 'the') AND NOT list_has_any(ws, ['is', 'for'])"),
    ),
    "text_match_any": (
        text_match_any,
        _set_sql("list_has_any(ws, ['und', 'des', 'los']) AND NOT list_contains(ws, 'die')"),
    ),
    "text_match_absent": (
        text_match_absent,
        _set_sql("NOT list_has_any(ws, ['the', 'de'])"),
    ),
    "phrase_pairs": (
        phrase_pairs,
        f"""
WITH {HITS_SQL}
SELECT DISTINCT a.posting_id
FROM hits a JOIN hits b ON b.posting_id = a.posting_id AND b.pos = a.pos + 1 AND b.term = 'the'
WHERE a.term = 'of' AND a.posting_id IN (
  SELECT c.posting_id FROM hits c JOIN hits e ON e.posting_id = c.posting_id AND e.pos = c.pos + 1
  WHERE c.term = 'in' AND e.term = 'the')""",
    ),
    "text_match_phrase": (
        text_match_phrase,
        f"""
WITH {HITS_SQL},
pairs AS (SELECT posting_id, term || ' ' || lead(term) OVER (PARTITION BY posting_id ORDER BY pos) AS two
          FROM hits)
SELECT posting_id FROM pairs WHERE two IN ('of the', 'in the')
GROUP BY 1 HAVING count(DISTINCT two) = 2""",
    ),
    "text_rank": (
        text_rank,
        f"""
WITH {HITS_SQL}
SELECT query_id, posting_id, round(rank, 9) AS rank FROM (
{rank_sql("one", ["the"])} UNION ALL {rank_sql("two", ["the", "of"])}
UNION ALL {rank_sql("three", ["and", "in", "is"])} UNION ALL {rank_sql("de", ["la", "de"])})""",
    ),
    "search_text": (
        search_text,
        _search_sql("n_chars AS salary_from_base, published_at"),
    ),
    "search_clustered": (search_clustered, _search_sql("d.title, d.body AS description")),
    "search_topk_blocks": (
        search_topk_blocks,
        f"""
WITH {HITS_SQL}
SELECT * FROM (
  SELECT query_id, posting_id, round(rank, 9) AS rank, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY round(rank, 9) DESC, posting_id) AS INTEGER) AS place
  FROM ({" UNION ALL ".join(rank_sql(q, ws) for q, ws in BLOCK_QUERIES.items())}))
WHERE place <= 5""",
    ),
    "stem_vocabulary": (
        stem_terms,
        f"WITH {HITS_SQL} SELECT DISTINCT term, substr(term, 1, 5) AS stem FROM hits",
    ),
    "stemmed_words": (
        stemmed_words,
        f"""
WITH {HITS_SQL}
SELECT substr(term, 1, 5) AS stem, count(DISTINCT posting_id) AS documents, count(*) AS n_words
FROM hits GROUP BY 1""",
    ),
    "extract_text": (page_text, _PAGE_TEXT_SQL),
    "sentence_split": (sentence_split, f"WITH {_sentences_sql('documents')} SELECT * FROM sents"),
    "chunk_documents": (
        document_chunks,
        _chunks_sql("SELECT doc_id, text, '' AS prefix, 300 AS budget FROM documents", 60, "doc_id"),
    ),
    "chunk_titled_pages": (titled_chunks, _TITLED_CHUNKS_SQL),
    "chunk_invariants": (
        chunk_invariants,
        """
SELECT doc_id, count(DISTINCT word) AS distinct_words, true AS no_gaps
FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS word
      FROM documents)
WHERE word <> '' GROUP BY doc_id""",
    ),
    "indexing_counts": (
        indexing_counts,
        f"""
SELECT count(*) FILTER (WHERE NOT contains(url, '/en/')) AS postings_processed,
       (SELECT count(*) FROM ({_TITLED_CHUNKS_SQL}) JOIN pages p USING (page_id)
        WHERE NOT contains(p.url, '/en/')) AS chunks_written,
       count(*) FILTER (WHERE contains(url, '/en/')) AS postings_skipped
FROM pages""",
    ),
    "indexed_chunks": (
        indexed_chunks,
        f"SELECT *, 'new' AS model_name, true AS own_vector FROM ({_TITLED_CHUNKS_SQL})",
    ),
    "indexed_models": (
        indexed_models,
        "SELECT 'new' AS model_name, count(*) AS postings, CAST(0 AS BIGINT) AS mixed FROM pages",
    ),
    "hash_embed": (hash_vectors, None),
    "hash_norms": (
        hash_norms,
        """
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm,
       CAST(384 AS BIGINT) AS dim
FROM documents""",
    ),
    "word_counts": (
        word_counts,
        """
SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_words
FROM conversations""",
    ),
}
