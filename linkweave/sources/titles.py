"""A title index: postings of short runs of letters, so that a search reads a few of them instead of all titles.

A posting is (gram, length, title, id) for each run of one, two or three
characters of a title's key, once a title. Postings are sorted by gram, then
as answers are ranked first, by length; Parquet's own statistics find their
rows. How many there are of a gram and length is kept beside: a search begins
with the rarest grams of what is asked, and one for a single gram reads only
the lengths that its answer has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key
from ..storage import discard, stored

GRAM = 3
#: Grams of a search that are intersected, the rarest ones; what is left is compared whole.
MET = 3
POSTING = "gram string, length int, title string, id string"


def postings(articles: DataFrame) -> DataFrame:
    """(gram, length, title, id) of articles(id, title); null titles have none.

    Plain rows and filters, which Spark compiles, in place of functions over
    arrays: a run of letters counts where the key has it first.
    """
    at = articles.where("title is not null").select("id", "title", key(F.col("title")).alias("k")).where("k <> ''").withColumn("p", F.explode(F.expr("sequence(1, length(k))")))
    runs = at.withColumn("n", F.explode(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]))).where("p + n - 1 <= length(k)").withColumn("gram", F.expr("substring(k, p, n)"))
    return runs.where("instr(k, gram) = p").select("gram", F.length("title").alias("length"), "title", "id")


def write(articles: DataFrame, path: str) -> None:
    """The postings in order, and their counts. Ranges are cut by gram, length and title, so that a gram of most titles is spread over tasks.

    Titles are stored, postings, which are many times as many, are written
    once; their counts come from what is written, of which they read two columns.
    """
    a = stored(articles.select("id", "title"), "titles")
    order = ["gram", "length", "title", "id"]
    # small row groups: little is read beside what is asked for
    postings(a).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 1 << 20).option("parquet.enable.dictionary#title", "false").option("parquet.enable.dictionary#id", "false").parquet(f"{path}/postings")
    discard(a)
    n = a.sparkSession.read.schema(POSTING).parquet(f"{path}/postings").groupBy("gram", "length").agg(F.count("*").alias("n"))
    n.repartitionByRange("gram", "length").sortWithinPartitions("gram", "length").write.parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, text: str, limit: int = 20) -> DataFrame:
    """(id, title) of the titles whose key holds the key of a text, the shortest first, then by title and id: the rows of rank.search() (G1, O3).

    A text of up to GRAM characters is one gram: postings up to the length at
    which there are ``limit`` of them hold the answer. A longer one intersects
    the postings of its rarest grams and compares what is left. An empty text
    finds nothing.
    """
    read = spark.read.schema(POSTING).parquet(f"{path}/postings")
    counts = spark.read.schema("gram string, length int, n long").parquet(f"{path}/counts")
    q = spark.range(1).select(key(F.lit(text))).first()[0]
    ranked = lambda df: df.orderBy("length", F.collate("title", "UNICODE"), "id").limit(limit).select("id", "title")
    if not q:
        return ranked(read.limit(0))
    if len(q) <= GRAM:
        far, n = 0, 0
        for r in counts.where(F.col("gram") == q).orderBy("length").collect():  # a row a length of titles
            far, n = r["length"], n + r["n"]
            if n >= limit:
                break
        return ranked(read.where((F.col("gram") == q) & (F.col("length") <= far)))
    grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
    known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if len(known) < len(grams):  # a gram that no title has
        return ranked(read.limit(0))
    rare = sorted(grams, key=lambda g: (known[g], g))[:MET]
    found = read.where(F.col("gram") == rare[0])
    for g in rare[1:]:
        found = found.join(read.where(F.col("gram") == g).select("id", "title"), ["id", "title"], "left_semi")
    return ranked(found.where(F.contains(key(F.col("title")), F.lit(q))))
