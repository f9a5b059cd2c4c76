"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of consecutive words. The corpus' document frequency of every test word says which two
words of a window are its rarest (of equals the one that stands first); windows with a word that the corpus lacks cannot
occur. The index holds the postings (word, document, position) of those rarest words over all documents. A window's
candidates are the postings of its rarest word, shifted back by the word's offset, intersected with the shifted postings
of the second rarest. Candidates are then grouped by document and compared word for word, which gives exact phrase
matches. With a slop, the second word may be so far off its place, and a window that is not there as a phrase but whose
words all lie within the span, widened by the slop at both ends, is a proximity match.

DataFrame functions only. Windows travel as numbers until a document's candidates are compared. Test words and windows
are broadcast only if they are counted and measured to be small (BROADCAST_ROWS and BROADCAST_BYTES); otherwise they are
joined by shuffle, with the same result. A document is held with its words and candidates: at most one exact match a
place and window length, so memory grows with the longest document and not with the corpus.

Defined cases: null and empty texts have no words and no hits; a shorter item is one window; equal windows of several
items count for each; rows that repeat a doc_id are matched each for itself; the longest texts are searched whole; an
empty table gives no rows, and an empty benchmark no hits; extra columns, whatever their names, are ignored by matches()
and summary() and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_ROWS, lower_az, only, packed, shared_dir, stored, table

#: Words of a window; how far off its place a word of a near match may be, in op8.
WINDOW, SLOP = 10, 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 16 << 20
HIT = "array<struct<start:int,n:int,wid:bigint>>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _few(df: DataFrame, letters: Column) -> DataFrame:
    """df, a written table, to be broadcast if its rows are few and their letters too; to be shuffled otherwise."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(letters), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size + 64 * rows <= BROADCAST_BYTES else df.hint("merge")


def windows(bench: DataFrame, length: int = WINDOW) -> DataFrame:
    """(terms, items): each distinct window and the items that have it, as strings."""
    items = only(bench, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") <= length, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length)))
    return items.select("item", F.explode(cut).alias("terms")).groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items"))


def anchored(docs: DataFrame, own: DataFrame, folder: str) -> DataFrame:
    """(wid, terms, t1, o1, t2, o2): windows that may occur, with their rarest words and offsets (t2 null for one word)."""
    vocabulary = stored(own.select(F.explode("terms").alias("term")).distinct(), f"{folder}/vocabulary")
    df = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(_few(vocabulary, F.length("term")), "term").groupBy("term").agg(F.count("*").alias("df"))
    df = stored(df, f"{folder}/df")
    ranked = own.select("wid", F.posexplode("terms").alias("o", "term")).join(_few(df, F.length("term")), "term", "left")
    best = ranked.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("df", "o", "term"))).alias("r"), F.bool_and(F.col("df").isNotNull()).alias("may"))
    best = best.where("may").select("wid", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"), F.get("r", F.lit(1))["term"].alias("t2"), F.get("r", F.lit(1))["o"].alias("o2"))
    return stored(own.select("wid", "terms").join(best, "wid"), f"{folder}/anchored")


def postings(docs: DataFrame, terms: DataFrame, folder: str) -> DataFrame:
    """(term, doc_id, row, pos) of the given words in all documents, stored."""
    terms = stored(terms, f"{folder}/terms")
    every = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return stored(every.join(_few(terms, F.length("term")), "term").select("term", "doc_id", "row", "pos"), f"{folder}/postings")


def candidates(index: DataFrame, anchors: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, row, start, wid): where both rarest words of a window stand at their offsets, give or take the slop; may repeat."""
    letters = F.length("t1") + F.coalesce(F.length("t2"), F.lit(0))
    own = anchors.select("wid", "t1", "o1", "t2", "o2")
    first = index.join(_few(own, letters), F.col("term") == F.col("t1")).select("doc_id", "row", (F.col("pos") - F.col("o1")).alias("start"), "wid", "t2", "o2").where(f"start >= {-slop}")
    alone = first.where("t2 is null")
    # Postings meet by blocks of places, so that a widened place asks one block or two and not each place of its own.
    block, at = 2 * slop + 1, F.col("start") + F.col("o2")
    blocks = F.array_distinct(F.array(F.floor((at - slop) / block), F.floor((at + slop) / block)))
    both = first.where("t2 is not null").withColumn("place", at).withColumn("block", F.explode(blocks))
    second = index.select(F.col("term").alias("term2"), F.col("doc_id").alias("doc2"), F.col("row").alias("row2"), F.col("pos").alias("pos2"), F.floor(F.col("pos") / block).alias("block2"))
    here = (F.col("t2") == F.col("term2")) & (F.col("block") == F.col("block2")) & F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("row") == F.col("row2"))
    met = both.join(second, here & (F.abs(F.col("pos2") - F.col("place")) <= slop), "left_semi")
    at_last = ["doc_id", "row", "start", "wid"]
    return alone.select(*at_last).unionByName(met.select(*at_last))


def located(docs: DataFrame, bench: DataFrame, length: int = WINDOW, slop: int = 0, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc, row, n_words, hits, near), (wid, items)): each row of docs as a struct with its exact and proximity matches."""
    folder = folder or shared_dir(docs.sparkSession)
    plain = only(docs, "doc_id", "text")
    own = stored(windows(bench, length).withColumn("wid", F.monotonically_increasing_id()), f"{folder}/windows")
    anchors = anchored(plain, own, folder)
    terms = anchors.select(F.explode(F.array("t1", "t2")).alias("term")).where("term is not null").distinct()
    found = candidates(postings(plain, terms, folder), anchors, slop)
    letters = F.aggregate("terms", F.lit(0), lambda n, t: n + F.length(t))
    told = found.join(_few(anchors.select("wid", "terms"), letters), "wid")
    by_doc = told.groupBy(F.col("doc_id").alias("found_doc"), F.col("row").alias("found_row")).agg(F.collect_set(F.struct("start", "terms", "wid")).alias("found"))
    rows = packed(docs, F.xxhash64("text").alias("row"))
    met = rows.join(by_doc, F.col("doc.doc_id").eqNullSafe(F.col("found_doc")) & (F.col("row") == F.col("found_row")), "left").withColumn("words", words(F.col("doc.text")))

    def exact(c: Column) -> Column:
        return (c["start"] >= 0) & (F.slice("words", F.greatest(F.lit(1), c["start"] + 1), F.size(c["terms"])) == c["terms"])

    def close(c: Column) -> Column:
        begin = F.greatest(F.lit(1), c["start"] + 1 - slop)
        span = F.slice("words", begin, F.greatest(F.lit(0), c["start"] + F.size(c["terms"]) + slop + 1 - begin))
        return ~exact(c) & (F.size(F.array_intersect(c["terms"], span)) == F.size(F.array_distinct(c["terms"])))

    def short(c: Column) -> Column:
        return F.struct(F.greatest(F.lit(0), c["start"]).alias("start"), F.size(c["terms"]).alias("n"), c["wid"].alias("wid"))

    none = F.expr(f"cast(array() as {HIT})")
    hits, near = (F.coalesce(F.transform(F.filter("found", kind), short), none) for kind in (exact, close))
    return met.select("doc", "row", F.size("words").alias("n_words"), hits.alias("hits"), (near if slop else none).alias("near")), own.select("wid", "items")


def matches(docs: DataFrame, bench: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, start, n_words, kind): every phrase or, with a slop, near match."""
    found, items = located(only(docs, "doc_id", "text"), bench, length, slop)

    def of_kind(column: str, kind: str) -> Column:
        return F.transform(column, lambda h: F.struct(h["start"].alias("start"), h["n"].alias("n_words"), h["wid"].alias("wid"), F.lit(kind).alias("kind")))

    kinds = F.concat(of_kind("hits", "phrase"), of_kind("near", "near"))
    rows = found.select("doc.doc_id", F.explode(kinds).alias("m")).select("doc_id", "m.*").join(items, "wid")
    return rows.select("doc_id", F.explode("items").alias("item_id"), "start", "n_words", "kind")


def summary(docs: DataFrame, bench: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_near, items): words, words in phrase matches, near matches, sorted items of phrase matches."""
    folder = shared_dir(docs.sparkSession)
    found, items = located(only(docs, "doc_id", "text"), bench, length, slop, folder)
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    rows = found.select("doc.doc_id", "row", F.col("n_words").cast("long"), hit.cast("long").alias("n_hit"), F.size("near").cast("long").alias("n_near"), F.array_distinct("hits.wid").alias("wids"))
    rows = stored(rows, f"{folder}/counts")
    of_doc = rows.where("n_hit > 0").select("doc_id", "row", F.explode("wids").alias("wid")).distinct().join(items, "wid")
    said = of_doc.select(F.col("doc_id").alias("said_doc"), F.col("row").alias("said_row"), F.explode("items").alias("item")).groupBy("said_doc", "said_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    met = rows.join(said, F.col("doc_id").eqNullSafe(F.col("said_doc")) & (F.col("row") == F.col("said_row")), "left")
    return met.select("doc_id", "n_words", "n_hit", "n_near", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs without any phrase match, columns unchanged."""
    found, _ = located(docs, bench)
    return found.where(F.size("hits") == 0).select("doc.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return made.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_near",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)
), found AS (
  SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.phrase = win.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
), terms AS (
  SELECT n, phrase, unnest(string_split(phrase, ' ')) AS term, generate_subscripts(string_split(phrase, ' '), 1) - 1 AS o FROM (SELECT DISTINCT n, phrase FROM win)
), df AS (
  SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM terms) GROUP BY term
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY df, o) AS r, count(df) OVER (PARTITION BY phrase) = n AS may FROM terms LEFT JOIN df USING (term)
), anchor AS (
  SELECT a.phrase, a.n, a.term AS t1, a.o AS o1, b.term AS t2, b.o AS o2 FROM ranked a JOIN ranked b ON a.phrase = b.phrase AND a.r = 1 AND b.r = 2 WHERE a.may
), first AS (
  SELECT p.doc_id, p.pos - a.o1 AS s, a.* FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM dw) p JOIN anchor a ON p.term = a.t1 WHERE p.pos - a.o1 >= -2
), near AS (
  SELECT f.doc_id, count(*) AS n_near FROM first f JOIN dw USING (doc_id)
  WHERE list_contains(w[greatest(1, s + o2 - 1) : s + o2 + 3], t2) AND list_has_all(w[greatest(1, s - 1) : s + n + 2], string_split(phrase, ' '))
    AND NOT (s >= 0 AND array_to_string(w[s + 1 : s + n], ' ') = phrase)
  GROUP BY f.doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
