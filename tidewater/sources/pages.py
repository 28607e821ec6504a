"""Paged responses of contracts: landed pages are followed by their cursors, read by type, and quarantined where broken.

A landed page is a JSON line: contract, query, what was asked (user, start_after, limit), when, and the answer's body as
text, or an error; `until` where the page is known to cover all cursors up to one, whatever its items are. Pages are landed by live.py or by any other client, under contract=.../query=... folders, so that a
read opens only its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import scan
from tidewater.sources.reads import READS, Read
from tidewater.sources.scratch import stash

PAGE = "user string, start_after string, until string, limit long, landed_at long, body string, error string"
#: Pages in one file, which is compressed, so that one task reads it.
FILE_PAGES = 20_000
#: So many pages at most are named to all tasks that read the others.
BROADCAST_PAGES = 300_000
_KEY = ["user", "after"]


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages under a folder; `broken` has the text of lines that are no page."""
    return spark.read.schema(f"{PAGE}, broken string, contract string, query string").option("columnNameOfCorruptRecord", "broken").json(folder)


def land(pages: DataFrame, folder: str, contract: str | None = None, query: str | None = None) -> None:
    """Add pages (contract, query and the columns of PAGE) to a folder. If they are known to be of one read, they go to
    its folder as they come; else each task sorts its own by read. Answers repeat their fields' names in each item, so
    files are compressed."""
    if contract and query:
        pages, folder = pages.drop("contract", "query"), f"{folder}/contract={contract}/query={query}"
    out = pages.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES)
    (out if contract and query else out.partitionBy("contract", "query")).json(folder)


def answered(pages: DataFrame, contract: str, query: str) -> DataFrame:
    """The pages of one read with their answer (by its schema), n items, first and last cursor, and a reason if broken.
    The filter prunes the folders of other reads."""
    read = READS[contract, query]
    mine = pages.filter((F.col("contract") == contract) & (F.col("query") == query))
    text = F.concat(F.lit('{"items":'), F.col("body"), F.lit("}")) if read.bare else F.col("body")
    answer = F.from_json(text, f"{read.schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    rows = mine.withColumn("answer", answer)
    items = F.col(f"answer.{read.items}") if read.items else F.array(F.lit(1))
    reason = F.when(F.col("broken").isNotNull(), "no page").when(F.col("error").isNotNull(), "error").when(F.col("body").isNull(), "no answer")
    reason = reason.when(F.col("answer.broken").isNotNull() | F.col("answer").isNull() | (items.isNull() if read.items else F.lit(False)), "unfit answer")
    rows = rows.withColumns({"reason": reason, "n": F.coalesce(F.size(items), F.lit(0)).cast("long")})
    last = F.try_element_at(items, F.lit(-1))
    return rows.withColumn("last", F.coalesce("until", _cursor(read, last)) if read.cursor else F.lit(None).cast("string"))


def _cursor(read: Read, item):
    return F.element_at(F.transform(F.array(item), lambda x: _of_item(read.cursor, x)), 1).cast("string")


def _of_item(cursor: str, item):
    """The cursor's expression (item.a.b, item[0], coalesce of such) over a column."""
    if cursor.startswith("coalesce("):
        return F.coalesce(*(_of_item(c.strip(), item) for c in cursor[9:-1].split(",")))
    if cursor == "item[0]":
        return item[0]
    for field in cursor.split(".")[1:]:
        item = item[field]
    return item


def _place(read: Read, cursor: str):
    """Where a page stands in its chain: pages without a cursor first, then in the order in which contracts list keys."""
    return F.col(cursor).cast("decimal(38,0)") if read.numeric else F.col(cursor)


def _keyed(pages: DataFrame, contract: str, query: str) -> DataFrame:
    """answered, with the chain (user) and the place in it (after) without nulls."""
    return answered(pages, contract, query).withColumns({"user": F.coalesce("user", F.lit("")), "after": F.coalesce("start_after", F.lit(""))})


def _of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) these pages. A few pages are broadcast, so that no answer is moved."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_PAGES else keys, _KEY, how)


class _Landings:
    """What following takes of a read's landings: everything but the answers, which are many times as large. Answers are
    read again from the landed files once it is known which of them count, and go through no shuffle unless many
    pages are left out, or were landed well more than once."""

    def __init__(self, pages: DataFrame, contract: str, query: str):
        self.read, self.where = READS[contract, query], (contract, query)
        self.pages = pages
        rows = _keyed(pages, contract, query)
        self.rows = stash(rows.select(*_KEY, "start_after", "limit", "until", "landed_at", "reason", "n", "last"), "landings")
        good = self.rows.filter("reason is null")
        #: pages with several good landings, and of each the one that counts, as a landed page.
        self.several = stash(good.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*_KEY), "several")
        self.again = None
        if not self.several.isEmpty():
            best = F.max_by(F.struct(*pages.columns), F.struct("landed_at", "body")).alias("p")
            self.again = stash(_of(rows.filter("reason is null"), self.several, "left_semi").groupBy(*_KEY).agg(best).select("p.*"), "again")
            good = good.join(self.several, _KEY, "left_anti").unionByName(_keyed(self.again, contract, query).select(*good.columns))
        self.newest = good

    def chains(self, share_rows: int = scan.SHARE_ROWS) -> DataFrame:
        """Of each page, by its newest good landing: user, after, reached, ended."""
        ended = F.col("limit").isNull() | (F.col("n") < F.col("limit")) & F.col("until").isNull()
        if not self.read.cursor:
            return self.newest.select(*_KEY, F.lit(True).alias("reached"), F.lit(True).alias("ended"))
        links = self.newest.filter("last is not null").select("user", F.col("last").alias("after"), F.lit(True).alias("known")).dropDuplicates(_KEY)
        linked = self.newest.join(links, _KEY, "left")
        missing = F.when((F.col("after") == "") | F.col("known"), 0).otherwise(1).cast("long")
        placed = linked.withColumns({"missing": missing, "first": (F.col("after") != ""), "place": _place(self.read, "start_after")})
        out = scan.running(placed, ["user"], ["first", "place"], {"gaps": scan.total("missing")}, share_rows, counted=self.newest)
        return out.select(*_KEY, (F.col("gaps") == 0).alias("reached"), ended.alias("ended"))

    def unreached(self) -> DataFrame:
        return stash(self.chains().filter("not reached").select(*_KEY), "unreached")

    def answers(self) -> DataFrame:
        """answered, of each page's good landings the newest; broken ones are still among the rows, as a filter on their
        reason here would have each answer parsed several times."""
        rows = _keyed(self.pages, *self.where)
        if self.again is None:
            return rows
        return _of(rows, self.several, "left_anti").unionByName(_keyed(self.again, *self.where))


def followed(pages: DataFrame, contract: str, query: str, share_rows: int = scan.SHARE_ROWS) -> DataFrame:
    """answered, one landing a page, with what following the cursors shows: `reached` (every page from the chain's first
    one to this one is there and fits) and `ended` (it has fewer items than its limit: no page comes after it).

    A chain is the pages of one contract, query and user. Of several landings of a page the newest good one counts.
    A page follows the page whose last cursor it was asked to start after; a join finds that page, and a scan over the
    chain's pages in order counts the missing links so far, in shares where a chain outgrows a task.
    """
    landings = _Landings(pages, contract, query)
    return landings.answers().filter("reason is null").join(landings.chains(share_rows), _KEY).select("contract", "query", "user", "start_after", "limit", "landed_at", "answer", "n", "last", "reached", "ended")


def read_rows(pages: DataFrame, contract: str, query: str) -> DataFrame:
    """user and the items (or the answer) of all pages that were reached, as typed columns."""
    read = READS[contract, query]
    landings = _Landings(pages, contract, query)
    rows = _of(landings.answers(), landings.unreached(), "left_anti")
    user = F.when(F.col("user") != "", F.col("user")).alias("asked_user")
    if read.items is None:
        return rows.filter("reason is null").select(user, *(F.col(f"answer.{c}") for c in rows.schema["answer"].dataType.names if c != "broken"))
    fit = F.when(F.col("reason").isNull(), F.col(f"answer.{read.items}"))
    item = rows.select(user, F.posexplode_outer(fit).alias("at", "item")).filter("at is not null").drop("at")  # explode would filter, and parse, first
    return item.select("asked_user", "item.*") if hasattr(item.schema["item"].dataType, "names") else item


def quarantine(pages: DataFrame, contract: str, query: str) -> DataFrame:
    """Landings that no row was read from: user, start_after, landed_at, reason and the text; good pages behind a gap have
    the reason 'unreached'."""
    rows = answered(pages, contract, query).filter("reason is not null")
    text = F.coalesce("broken", "error", "body")
    bad = rows.select("user", "start_after", "landed_at", "reason", text.alias("text"))
    landings = _Landings(pages, contract, query)
    gap = _of(landings.answers().filter("reason is null"), landings.unreached(), "left_semi")
    return bad.unionByName(gap.select(F.when(F.col("user") != "", F.col("user")).alias("user"), "start_after", "landed_at", F.lit("unreached").alias("reason"), F.to_json("answer").alias("text")))


def quarantine_counts(pages: DataFrame, reads: list[tuple[str, str]] | None = None) -> DataFrame:
    """contract, query, reason, n: quarantined landings of each read that has some. Lines that are no page at all count
    under the read whose folder they lie in."""
    out = None
    for contract, query in reads or list(READS):
        landings = _Landings(pages, contract, query)
        bad = landings.rows.filter("reason is not null").select("reason").unionByName(landings.unreached().select(F.lit("unreached").alias("reason")))
        one = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(contract).alias("contract"), F.lit(query).alias("query"), "reason", "n")
        out = one if out is None else out.unionByName(one)
    return out
