"""The activity ledger and job progress, as batch aggregations and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAPACITY = 500


def is_local(authority: Column) -> Column:
    """Whether an authority is the loopback interface."""
    return authority.startswith("127.") | authority.startswith("[::1]")


def _local(authority: str) -> bool:
    return authority.startswith(("127.", "[::1]"))


def admitted_endpoint(authority: Column) -> Column:
    """host:port as it is contacted, null if it is not loopback: only 127/8, ::1 and localhost, ports 1 to 65535."""
    host = F.regexp_extract(authority, r"^(\[[0-9a-fA-F:.]+\]|[^:\[\]]+)(?::([0-9]{1,5}))?$", 1)
    port = F.nullif(F.regexp_extract(authority, r"^(\[[0-9a-fA-F:.]+\]|[^:\[\]]+)(?::([0-9]{1,5}))?$", 2), F.lit(""))
    name = F.when(F.lower(host) == "localhost", "127.0.0.1").when(host.rlike(r"^127(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$") | (host == "[::1]"), host)
    return F.when(port.isNull(), name).when(port.cast("int").between(1, 65535), F.concat(name, F.lit(":"), port.cast("int").cast("string")))


def totals(ledger: DataFrame, by: list[str]) -> DataFrame:
    """by, requests, bytes_sent, bytes_received, refusals, addresses, stayed, documents_stayed of ledger entries.

    Columns: purpose, authority, outcome, bytes_sent, bytes_received. Addresses count allowed ones; a scope stayed
    local if all of them are; its documents did if each request for document work was refused or local.
    """
    allowed = F.col("outcome") == "allowed"
    work = F.col("purpose") == "documentWork"
    return ledger.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("bytes_received").alias("bytes_received"), F.count_if(F.col("outcome") == "refused").alias("refusals"),
        F.count_distinct(F.when(allowed, F.col("authority"))).alias("addresses"),
        F.coalesce(F.bool_and(F.when(allowed, is_local(F.col("authority")))), F.lit(True)).alias("stayed"),
        F.coalesce(F.bool_and(F.when(work, (F.col("outcome") == "refused") | is_local(F.col("authority")))), F.lit(True)).alias("documents_stayed"),
    )


def last_entries(ledger: DataFrame, by: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The ``capacity`` latest entries (at, seq) of each scope; keeping so many is the ledger's feature."""
    w = Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("seq"))
    return ledger.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= capacity)


#: Events of a translation, and what ``value`` and ``of`` say: pages; page, of; blocks, seconds as of; blocks, contested;
#: questions; names; block, of; page; nothing.
EVENTS = ("started", "pageStarted", "readerFinished", "pageReconciled", "asking", "readDocument", "blockTranslated", "pageFinished", "finished")
_STATE = "pages int, page int, blocks int, done int, contested int, finished boolean"


def fold(state: tuple, event: str, value: int, of: int = 0) -> tuple:
    """One event folded into (pages, page, blocks and done on that page, contested, finished); others change nothing."""
    pages, page, blocks, done, contested, finished = state
    if event == "started":
        return value, page, blocks, done, contested, finished
    if event == "pageStarted":
        return pages, value, 0, 0, contested, finished
    if event == "pageReconciled":
        return pages, page, value, done, contested + of, finished
    if event == "blockTranslated":
        return pages, page, of, value + 1, contested, finished
    return pages, page, blocks, done, contested, finished or event == "finished"


def flow_events(documents: DataFrame, blocks: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """job, seq, event, value, of: what a run over whole documents tells of itself, in the order in which it happens.

    Documents are (doc_id, n_pages), blocks (doc_id, page, ord, contested), readings (doc_id, page, reader, n_blocks,
    seconds). A document begins; each of its pages, also one without blocks, begins, is read by each of its readers (in
    order of their names), reconciled, translated block by block, and ends; then the document ends. Numbers come from
    sums over a document's pages, so no task orders all events of a document. Null ``contested`` is not; a document
    without pages begins and ends.
    """
    page = Window.partitionBy("doc_id", "page")
    each = blocks.select("doc_id", F.col("page").cast("int").alias("page"), (F.row_number().over(page.orderBy("ord")) - 1).alias("at"), F.coalesce("contested", F.lit(False)).alias("contested"))
    many = each.groupBy("doc_id", "page").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if("contested").cast("int").alias("contested"))
    pages = documents.where("n_pages > 0").select("doc_id", F.col("n_pages").cast("int").alias("n_pages"), F.explode(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1)).alias("page")).join(many, ["doc_id", "page"], "left")
    if readings is None:
        pages = pages.withColumn("readers", F.lit(0))
    else:
        told = readings.select("doc_id", F.col("page").cast("int").alias("page"), "reader", F.col("n_blocks").cast("int").alias("value"), F.col("seconds").cast("int").alias("of"))
        told = told.withColumn("at", F.row_number().over(page.orderBy("reader")) - 1)
        pages = pages.join(told.groupBy("doc_id", "page").agg(F.count(F.lit(1)).cast("int").alias("readers")), ["doc_id", "page"], "left")
    pages = pages.fillna(0, ["n", "contested", "readers"])
    before = F.coalesce(F.sum(F.col("readers") + F.col("n") + 3).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = pages.withColumn("first", before + 1)

    def event(df: DataFrame, seq: Column | int, name: str, value: Column | int, of: Column | int) -> DataFrame:
        whole = lambda c: c if isinstance(c, Column) else F.lit(c)
        return df.select(F.col("doc_id").alias("job"), whole(seq).cast("long").alias("seq"), F.lit(name).alias("event"), whole(value).cast("int").alias("value"), whole(of).cast("int").alias("of"))

    c = F.col
    size = pages.groupBy("doc_id").agg(F.sum(c("readers") + c("n") + 3).alias("size"))
    own = pages.select("doc_id", "page", "first", "readers", "n")
    out = [
        event(documents, 0, "started", c("n_pages"), 0), event(pages, c("first"), "pageStarted", c("page"), c("n_pages")),
        event(pages, c("first") + 1 + c("readers"), "pageReconciled", c("n"), c("contested")), event(each.join(own, ["doc_id", "page"]), c("first") + 2 + c("readers") + c("at"), "blockTranslated", c("at"), c("n")),
        event(pages, c("first") + 2 + c("readers") + c("n"), "pageFinished", c("page"), 0), event(documents.join(size, "doc_id", "left"), F.coalesce("size", F.lit(0)) + 1, "finished", 0, 0),
    ]
    if readings is not None:
        out.append(event(told.join(own, ["doc_id", "page"]), c("first") + 1 + c("at"), "readerFinished", c("value"), c("of")))
    return reduce(DataFrame.unionByName, out)


def fraction(pages: Column, page: Column, blocks: Column, done: Column) -> Column:
    """How much of a document is done: whole pages and the share of the present one; 0 before it is open, 1 at most."""
    within = F.when(blocks > 0, done / blocks).otherwise(0.0)
    return F.when(pages > 0, F.least(F.lit(1.0), (page + within) / pages)).otherwise(0.0)


def progress(events: DataFrame) -> DataFrame:
    """job, the state of :func:`fold` after its last event, and fraction, of events (job, seq, event, value, of).

    Each part of the state is what the last event that sets it says; a page's start sets its blocks to none.
    """
    kind = F.col("event")
    last = lambda c, *of: F.max(F.when(kind.isin(*of), F.struct("seq", c.alias("v"))))["v"]
    v, of = F.col("value"), F.col("of")
    blocks = F.when(kind == "pageStarted", 0).when(kind == "pageReconciled", v).otherwise(of)
    done = F.when(kind == "pageStarted", 0).otherwise(v + 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    out = events.groupBy("job").agg(
        zero(last(v, "started")).alias("pages"), zero(last(v, "pageStarted")).alias("page"), zero(last(blocks, "pageStarted", "pageReconciled", "blockTranslated")).alias("blocks"),
        zero(last(done, "pageStarted", "blockTranslated")).alias("done"), zero(F.sum(F.when(kind == "pageReconciled", of))).alias("contested"), F.bool_or(kind == "finished").alias("finished"),
    )
    return out.withColumn("fraction", fraction(*[F.col(c) for c in ("pages", "page", "blocks", "done")]))


def _stateful(df: DataFrame) -> DataFrame:
    """``df``, in a session whose state store can hold the states of processors: lists, maps and cells are kept in RocksDB only."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


class _Progress(StatefulProcessor):
    """A job's state, each part of it with the number of the event that set it: an earlier event that comes late sets nothing."""

    PARTS = ("pages", "page", "blocks", "done")

    def init(self, handle: StatefulProcessorHandle) -> None:
        cells = ", ".join(f"{p}_seq long, {p} int" for p in self.PARTS)
        self.state = handle.getValueState("state", f"{cells}, contested int, finished boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, 0) * 4 + (0, False)
        cells = {p: (held[2 * i], held[2 * i + 1]) for i, p in enumerate(self.PARTS)}
        contested, finished = held[8:]

        def put(part: str, seq: int, value: int) -> None:
            if cells[part][0] is None or (seq, value) > cells[part]:
                cells[part] = (seq, value)

        for pdf in rows:
            for seq, event, value, of in pdf.fillna({"seq": -1, "value": 0, "of": 0})[["seq", "event", "value", "of"]].itertuples(index=False):
                seq, value, of = int(seq), int(value), int(of)
                if event == "started":
                    put("pages", seq, value)
                elif event == "pageStarted":
                    put("page", seq, value)
                    put("blocks", seq, 0)
                    put("done", seq, 0)
                elif event == "pageReconciled":
                    put("blocks", seq, value)
                    contested += of
                elif event == "blockTranslated":
                    put("blocks", seq, of)
                    put("done", seq, value + 1)
                finished = finished or event == "finished"
        self.state.update((*(x for p in self.PARTS for x in cells[p]), contested, finished))
        yield pd.DataFrame([(*key, *(cells[p][1] for p in self.PARTS), contested, finished)], columns=["job", *[c.split()[0] for c in _STATE.split(", ")]])

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame) -> DataFrame:
    """job, state after each micro-batch of a stream (job, seq, event, value, of), and fraction: what :func:`progress` says
    of the events so far, in whatever order and batches they come. A job's state is ten numbers."""
    out = _stateful(events).groupBy("job").transformWithStateInPandas(_Progress(), f"job long, {_STATE}", "update", "None")
    return out.withColumn("fraction", fraction(*[F.col(c) for c in ("pages", "page", "blocks", "done")]))


#: The purpose of an entry that clears the ledger: what comes before it, by (at, seq), counts no more.
CLEAR = "clear"


def present(ledger: DataFrame, by: list[str], capacity: int = CAPACITY) -> DataFrame:
    """by, requests, bytes_sent, bytes_received, addresses, stayed, refusals, documents_stayed, n_entries, first_seq, last_seq.

    The ledger of each scope as it stands: since its last entry that clears it, requests, bytes and contacted addresses
    of all entries, refusals and whether documents stayed of the ``capacity`` latest, which are all that it keeps.
    Entries are (by, at, seq, purpose, authority, outcome, bytes_sent, bytes_received); scopes without any left have no row.
    """
    clears = ledger.where(F.col("purpose") == CLEAR).groupBy(*by).agg(F.max(F.struct("at", "seq")).alias("__cleared"))
    own = ledger.where(F.col("purpose") != CLEAR).join(clears, by, "left")
    own = own.where(F.col("__cleared").isNull() | (F.struct("at", "seq") > F.col("__cleared"))).drop("__cleared")
    kept = last_entries(own, by, capacity).groupBy(*by).agg(
        F.count_if(F.col("outcome") == "refused").alias("refusals"), F.coalesce(F.bool_and(F.when(F.col("purpose") == "documentWork", (F.col("outcome") == "refused") | is_local(F.col("authority")))), F.lit(True)).alias("documents_stayed"),
        F.count(F.lit(1)).alias("n_entries"), F.max(F.struct("nth", "seq"))["seq"].alias("first_seq"), F.min(F.struct("nth", "seq"))["seq"].alias("last_seq"),
    )
    return totals(own, by).drop("refusals", "documents_stayed").join(kept, by)


class _Ledger(StatefulProcessor):
    """One scope's ledger. Entries younger than the watermark wait, so that an entry or a clearing that comes late still
    takes its place; older ones are in the totals, the addresses and the latest entries for good."""

    ENTRY = "at long, seq long, purpose string, authority string, outcome string, bytes_sent long, bytes_received long"

    def __init__(self, by: str, capacity: int):
        self.by, self.capacity = by, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "requests long, bytes_sent long, bytes_received long")
        self.addresses = handle.getMapState("addresses", "authority string", "local boolean")
        self.latest, self.waiting = (handle.getListState(n, self.ENTRY) for n in ("latest", "waiting"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.ENTRY.split(", ")]
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for pdf in rows:
            waiting += [(int(a), int(s), p, n, o, int(x), int(y)) for a, s, p, n, o, x, y in pdf[names].itertuples(index=False)]
        waiting.sort(key=lambda e: e[:2])
        counts = list(self.totals.get()) if self.totals.exists() else [0, 0, 0]
        latest = [tuple(r) for r in self.latest.get()] if self.latest.exists() else []
        known = {k[0]: v[0] for k, v in self.addresses.iterator()}
        until = timers.getCurrentWatermarkInMs() * 1000
        settled = sum(e[0] < until for e in waiting)  # they come first: no later batch holds an entry before them

        def fold(counts: list, latest: list, known: dict, entries: list) -> tuple[list, list, dict]:
            counts, latest, known = list(counts), deque(latest, self.capacity), dict(known)
            for e in entries:
                if e[2] == CLEAR:
                    counts = [0, 0, 0]
                    latest.clear()
                    known.clear()
                    continue
                counts = [counts[0] + 1, counts[1] + e[5], counts[2] + e[6]]
                latest.append(e)
                if e[4] == "allowed":
                    known[e[3]] = _local(e[3])
            return counts, list(latest), known

        counts, latest, found = fold(counts, latest, known, waiting[:settled])
        if settled:
            self.totals.update(tuple(counts))
            self.latest.put(latest) if latest else self.latest.clear()
            if found != known:
                if not known.keys() <= found.keys():
                    self.addresses.clear()
                    known = {}
                for k, v in found.items():
                    if k not in known:
                        self.addresses.updateValue((k,), (v,))
        left = waiting[settled:]
        self.waiting.put(left) if left else self.waiting.clear()
        counts, latest, found = fold(counts, latest, found, left)
        if not latest:
            return
        stayed = all(e[4] == "refused" or _local(e[3]) for e in latest if e[2] == "documentWork")
        told = (*key, *counts, len(found), all(found.values()), sum(e[4] == "refused" for e in latest), stayed, len(latest), latest[0][1], latest[-1][1])
        yield pd.DataFrame([told], columns=[self.by, *PRESENT])

    def close(self) -> None:
        pass


PRESENT = ("requests", "bytes_sent", "bytes_received", "addresses", "stayed", "refusals", "documents_stayed", "n_entries", "first_seq", "last_seq")


def present_stream(ledger: DataFrame, by: str, late: str = "10 minutes", capacity: int = CAPACITY) -> DataFrame:
    """:func:`present` after each micro-batch of a stream of entries, for the scopes that it touches.

    Entries may come in any order as long as none is older than the watermark, ``late`` behind the youngest before; those
    that are count no more. A scope's state is its totals, its addresses, ``capacity`` entries, and those of the last ``late``.
    """
    typed = ledger.withColumn("__at", F.col("at")).withWatermark("__at", late)
    rows = typed.select(by, F.unix_micros("at").alias("at"), "seq", "purpose", "authority", "outcome", "bytes_sent", "bytes_received", "__at")
    kinds = dict(ledger.dtypes)
    schema = f"{by} {kinds[by]}, requests long, bytes_sent long, bytes_received long, addresses long, stayed boolean, refusals long, documents_stayed boolean, n_entries long, first_seq long, last_seq long"
    return _stateful(rows).groupBy(by).transformWithStateInPandas(_Ledger(by, capacity), schema, "update", "EventTime")


def line_stream(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, authority, error) with outcome, reason, n_lines and bytes_received of their lines.

    ``lines`` are (request_id, line) of streamed answers, one JSON object a line; bytes are counted as UTF-8 without
    line ends. A request with an error was refused, with what came before it.
    """
    came = lines.groupBy("request_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).cast("long").alias("bytes_received"))
    r = requests.join(came, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.select(*requests.columns, F.when(F.col("error").isNull(), "allowed").otherwise("refused").alias("outcome"), F.col("error").alias("reason"), zero("n_lines"), zero("bytes_received"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the NDJSON files under ``path``: each line, its fields by ``schema`` (null where it is no JSON), its bytes."""
    raw = spark.readStream.text(path)
    return raw.select(F.col("value").alias("line"), F.from_json("value", schema).alias("fields"), F.octet_length("value").alias("bytes"))


def slices(ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Downloads of models, requests for documents' work, and refusals of a ledger."""
    return ledger.where("purpose = 'modelWeights'"), ledger.where("purpose = 'documentWork'"), ledger.where("outcome = 'refused'")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: requests and bytes by purpose in tumbling windows of event time (column at), with a watermark."""
    w = F.window("at", length)
    return events.withWatermark("at", late).groupBy(w, "purpose").agg(F.count("*").alias("requests"), F.sum("bytes_sent").alias("bytes_sent")).select(F.col("window.start").alias("start"), "purpose", "requests", "bytes_sent")
