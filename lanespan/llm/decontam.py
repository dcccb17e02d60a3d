"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is stored: a posting (document, position, term) for each word of the training data, in files by document. It is
built once, and serves any number of test sets. A window is `size` consecutive words of a benchmark item; its marks are
the rarest of its terms that occur in the training data. The marks' lists, each shifted by the mark's offset, are
intersected from the rarest on: for exact matches on (document, window, start), for proximity matches within a slack.
Every place that is left is compared word by word, by the postings of all terms of the window around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanespan.llm.common import LOWER, UPPER, stash

SIZE = 13
MARKS = 3
#: A proximity match has all words of a window but one in so many (none in shorter ones), each at most so far from its place.
ONE_IN, SLACK = 13, 2
#: Terms and marks are sent to all executors up to so many rows; beyond that the joins are shuffled.
SENT_ROWS = 500_000
#: Positions are joined by cells of this length.
CELL = 16
#: Bounds of words; capitals are word characters here as they are lower-cased word by word later.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(c):
    return F.translate(c, UPPER, LOWER)


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def windows_of(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words, n: the windows of each item. An item of fewer words, but not none, is one window."""
    words = F.filter(F.split(lowered(F.coalesce(F.col(text_col), F.lit(""))), BREAK), lambda w: w != "")
    rows = items.select(F.col(id_col).alias("item_id"), words.alias("all")).where(F.size("all") > 0)
    rows = rows.withColumn("n", F.least(F.lit(size), F.size("all")))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("n") + 1)))
    return rows.select("item_id", F.slice("all", F.col("at"), F.col("n")).alias("words"), "n").distinct()


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, pos, term: a row for each word. mark is a hash of the text, as ids may repeat; positions follow each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))  # before the words, or each of them would hash its text
    words = rows.select("doc_id", "mark", F.posexplode(F.split("text", BREAK)).alias("pos", "w")).where("w <> ''")
    low = F.lower("w")
    # Most words are small already, and most others plain ASCII, where lower() does just what is wanted.
    term = F.when(low == F.col("w"), F.col("w")).when(F.octet_length("w") == F.length("w"), low).otherwise(lowered(F.col("w")))
    return words.select("doc_id", "mark", "pos", term.alias("term"))


class Index:
    """The stored postings, and searches of the windows of a benchmark in them.

    matches() returns exact matches, near() windows with all but a few of their words near their places, coverage() the sums
    by document. Documents are told apart by id and text, so rows that repeat both share one result, and rows that share
    only the id do not mix.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: DataFrame | None = None):
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"))
        self.postings = stash(postings_of(docs, id_col, text_col)) if postings is None else postings

    def save(self, path: str) -> None:
        self.postings.write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, docs: DataFrame, **columns) -> Index:
        """The index of docs that was saved at path."""
        return Index(docs, **columns, postings=spark.read.parquet(path))

    def words(self) -> DataFrame:
        """doc_id, mark, n_words of documents that have some."""
        return self.postings.groupBy("doc_id", "mark").agg((F.max("pos") - F.min("pos") + 1).cast("long").alias("n_words"))

    def search(self, items: DataFrame, size: int = SIZE, marks: int = MARKS, id_col: str = "item_id", text_col: str = "text", slack: int = SLACK) -> Search:
        return Search(self, items, size, marks, id_col, text_col, slack)


class Search:
    def __init__(self, index: Index, items: DataFrame, size: int, marks: int, id_col: str, text_col: str, slack: int):
        self.index, self.slack = index, slack
        found = stash(windows_of(items, size, id_col, text_col))
        phrases = stash(found.select("words", "n").distinct().withColumn("window", F.monotonically_increasing_id()))
        self.owners = stash(found.join(phrases, ["words", "n"]).select("window", "item_id"))
        places = stash(phrases.select("window", "n", F.posexplode("words").alias("offset", "term")))
        self.places, self.n_places = places, places.count()
        terms = stash(places.select("term").distinct())
        n_terms = terms.count()
        self.lists = index.postings.join(sent(terms, n_terms), "term")
        seen = stash(self.lists.groupBy("term").agg(F.count(F.lit(1)).alias("df")))

        absent = F.col("n") - F.count("df").over(Window.partitionBy("window"))
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("df").asc_nulls_last(), "term", "offset"))
        ranked = places.join(sent(seen, n_terms), "term", "left").withColumn("absent", absent).withColumn("rank", rank)
        ranked = ranked.where(F.col("df").isNotNull() & (F.col("rank") <= marks) & (F.col("absent") <= self.misses()))
        self.marks = stash(ranked.select("window", "n", "absent", "term", "offset", "rank", F.least(F.lit(marks), F.col("n") - F.col("absent")).alias("needed")))
        self.n_marks = self.marks.count()

    @staticmethod
    def misses():
        """Words that a proximity match of n may lack."""
        return F.floor(F.col("n") / ONE_IN)

    def places_to_look(self, near: bool) -> DataFrame:
        """doc_id, mark, window, n, start: where the marks' lists meet, all of them at one start, or all but the misses within the slack.

        Lists are taken from the rarest on. For exact matches each next list is only looked up at the places that are left.
        """
        lists = self.index.postings.join(sent(self.marks if near else self.marks.where("rank = 1 and absent = 0"), self.n_marks), "term")
        lists = lists.select("doc_id", "mark", "window", "n", "needed", "rank", (F.col("pos") - F.col("offset")).alias("start"))
        if near:
            by = Window.partitionBy("doc_id", "mark", "window").orderBy("start", "rank")
            close = F.lit(False)
            for side in (F.lag, F.lead):
                other = [side(c).over(by) for c in ("start", "rank")]
                close = close | F.coalesce((F.abs(other[0] - F.col("start")) <= 2 * self.slack) & (other[1] != F.col("rank")), F.lit(False))
            # Fewer than two marks are needed where a window has one, or has two and may lack one.
            alone = F.col("needed") - F.when(F.col("n") >= ONE_IN, F.greatest(F.lit(0), self.misses())).otherwise(F.lit(0)) < 2
            return lists.withColumn("close", close).where(F.col("close") | alone).select("doc_id", "mark", "window", "n", "start").distinct()
        left = lists.select("doc_id", "mark", "window", "n", "needed", "start").distinct()
        for r in range(2, MARKS + 1):
            mark = self.marks.where((F.col("rank") == r) & (F.col("absent") == 0)).select("window", "term", "offset")
            at = left.join(sent(mark, self.n_marks), "window", "left").withColumn("pos", F.col("start") + F.coalesce("offset", F.lit(0)))
            there = self.lists.join(sent(mark.select("term").distinct(), self.n_marks), "term", "left_semi").select("doc_id", "mark", "pos", "term")
            some = at.where("term is not null").join(there, [at["doc_id"].eqNullSafe(there["doc_id"]), at["mark"] == there["mark"], at["pos"] == there["pos"], at["term"] == there["term"]], "left_semi")
            left = at.where("term is null").unionByName(some).drop("term", "offset", "pos")
        return left.select("doc_id", "mark", "window", "n", "start")

    def compared(self, near: bool) -> DataFrame:
        """doc_id, mark, window, n, start, exact, near: the places, compared word by word."""
        wide = self.slack if near else 0
        places = stash(self.places_to_look(near))
        some = stash(places.select("doc_id", "mark").distinct())
        lists = self.lists.join(sent(some.select("mark").distinct(), some.count()), "mark", "left_semi").withColumn("cell", F.floor(F.col("pos") / CELL))
        asked = places.join(sent(self.places.select("window", "offset", "term"), self.n_places), "window")
        at = F.col("start") + F.col("offset")
        cells = F.sequence(F.floor((at - 2 * wide) / CELL), F.floor((at + 2 * wide) / CELL))
        asked = asked.withColumn("cell", F.explode(cells)).withColumnsRenamed({"doc_id": "__id", "mark": "__mark", "term": "__term", "cell": "__cell"})
        met = asked.join(lists, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__mark") == F.col("mark")) & (F.col("__term") == F.col("term")) & (F.col("__cell") == F.col("cell")))
        met = met.withColumn("shift", F.col("pos") - F.col("offset") - F.col("start")).where(F.abs("shift") <= 2 * wide)
        met = met.groupBy("doc_id", "mark", "window", "n", "start").agg(F.collect_set(F.struct("offset", "shift")).alias("met"))
        at_shift = lambda d, w: F.size(F.array_distinct(F.transform(F.filter("met", lambda x: F.abs(x["shift"] - d) <= w), lambda x: x["offset"])))
        most = F.array_max(F.transform(F.sequence(F.lit(-wide), F.lit(wide)), lambda d: at_shift(d, wide)))
        return met.select("doc_id", "mark", "window", "n", "start", (at_shift(F.lit(0), 0) == F.col("n")).alias("exact"), (most >= F.col("n") - self.misses()).alias("near"))

    def matches(self) -> DataFrame:
        """doc_id, mark, window, start, n: exact matches of whole windows, each once."""
        return self.compared(False).where("exact").select("doc_id", "mark", "window", "start", "n")

    def near(self) -> DataFrame:
        """doc_id, mark, window: for some start, all words of the window but the misses stand at most the slack away from their places."""
        return self.compared(True).where("near").select("doc_id", "mark", "window").distinct()

    def owned(self, windows: DataFrame) -> DataFrame:
        return windows.select("doc_id", "mark", "window").distinct().join(self.owners, "window").select("doc_id", "mark", "item_id").distinct()

    def coverage(self, near: bool = False) -> DataFrame:
        """One row per document row: doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated; with near also n_near, the items that match exactly or nearly."""
        found = stash(self.compared(near))
        hits = found.where("exact")
        before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("doc_id", "mark").orderBy("start", "n", "window").rowsBetween(Window.unboundedPreceding, -1))
        end = F.col("start") + F.col("n")
        covered = hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.col("start")))))
        covered = covered.groupBy("doc_id", "mark").agg(F.sum("new").alias("n_hit"))
        names = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
        owned = self.owned(hits).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", names).alias("names"))
        nearly = self.owned(found.where("near")).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n_near"))

        def with_(rows: DataFrame, more: DataFrame) -> DataFrame:
            more = more.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
            return rows.join(more, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["mark"] == F.col("__mark")), "left").drop("__id", "__mark")

        rows = with_(self.index.docs, self.index.words())
        for more in (covered, owned, *([nearly] if near else [])):
            rows = with_(rows, more)
        count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return rows.select(
            "doc_id", "mark", count("n_words").alias("n_words"), count("n_hit").alias("n_hit"), count("n_items").alias("n_items"),
            F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), ((count("n_hit") > 0) & (20 * count("n_hit") >= count("n_words"))).alias("contaminated"),
            *([count("n_near").alias("n_near")] if near else []),
        )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, marks: int = MARKS, near: bool = False, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with near n_near.

    Null texts have no words. Items without words have no windows; repeated items count once by id. With an empty
    benchmark nothing is hit; empty docs give an empty result. Ids may be null. Other columns are not read.
    """
    return Index(docs, id_col, text_col).search(items, size, marks, item_id, item_text).coverage(near).drop("mark")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Rows of a null id go by their text, as all others."""
    bad = Index(docs, id_col, text_col).search(items, **search).coverage().groupBy("doc_id", "mark").agg(F.max("contaminated").alias("bad")).where("bad")
    bad = stash(bad.select(F.col("doc_id").alias("__bad_id"), F.col("mark").alias("__bad_mark")))
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(sent(bad, bad.count()), docs[id_col].eqNullSafe(F.col("__bad_id")) & (mark == F.col("__bad_mark")), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dg.n AS n, item_id FROM dg JOIN bw ON dg.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
q AS (SELECT g, n, row_number() OVER () AS win FROM (SELECT DISTINCT g, n FROM bw)),
qp AS (SELECT win, n, g[o + 1] AS term, o FROM (SELECT win, n, g, unnest(range(0, n)) AS o FROM q)),
dt AS (SELECT doc_id, w[p + 1] AS term, p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d)),
enough AS (SELECT doc_id, win FROM (SELECT DISTINCT doc_id, term FROM dt) JOIN qp USING (term) GROUP BY doc_id, win, n HAVING count(DISTINCT o) >= n - n // 13),
nw AS (
  SELECT DISTINCT doc_id, win FROM (
    SELECT e.doc_id, e.win, qp.n, qp.o, unnest(range(dt.p - qp.o - 2, dt.p - qp.o + 3)) AS s
    FROM enough e JOIN qp ON e.win = qp.win JOIN dt ON dt.doc_id = e.doc_id AND dt.term = qp.term)
  GROUP BY doc_id, win, n, s HAVING count(DISTINCT o) >= n - n // 13),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nw JOIN q ON nw.win = q.win JOIN bw ON bw.g = q.g AND bw.n = q.n GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN ni ON d.doc_id = ni.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=True)
