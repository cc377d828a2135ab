"""WARC archives: write records, read any archive back, and index the captures in global order.

Archives are gzip files with a member for each record (WARC 1.1), written by Spark's text files, so they can
lie in any store that Spark reaches and a lost task is simply run again. A response holds an HTTP head and the payload. Archives are read in
two ways with one parser: files of at most ``WHOLE_FILE`` bytes by Spark's reader of binary files, larger
ones as streams; either way a task holds one record and one piece of a file. Archives of other makers are
read alike, compressed by record, as a whole or not at all.

The index is an external merge. Each archive partition sorts its captures into a run, which is stored; runs are cut
at common quantiles of (URL key, timestamp, page, archive, offset) by a range exchange into ranges of about ``MERGE_ROWS`` rows, and in
each a loser tree merges the k pieces. Ranges follow one another, so the whole index is in order and the captures
of a URL stand together by time. A hot host or URL, or a capture that repeats, is cut within, since the key
ends with the record's own place. Each entry names archive, offset and length, so a record is read by itself.

Null html is an empty payload, null URL an empty URL; a null timestamp is EPOCH, as is that of tables whose
captured_at is no timestamp. Of records with
equal payloads of ``MIN_REVISIT_BYTES`` or more the one with the smallest page_id is the response
(all of them, if rows with that page_id repeat), others are revisits without a block. Other columns
of the input are not archived.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from base64 import b64decode, b64encode
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_folder, store, tidy

MIN_REVISIT_BYTES = 100
#: WARC-Date of page 0 where a table has no capture time: a second more for each page_id.
EPOCH = 1_700_000_000
#: Records of one archive file at most, and bytes of a file that is read as one value.
RECORDS_PER_FILE, WHOLE_FILE = 5_000, 1 << 27
#: Bytes of a record in a gzip member: the length at a member's end must leave its last byte 0 (see write_archives).
MEMBER_BYTES = (1 << 24) - 1
#: Parts of the pages with one digest that meet in a task, and digests that may be broadcast (40 MB).
SALTS, BROADCAST_DIGESTS = 16, 400_000
MERGE_ROWS = 200_000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def dated(pages: DataFrame) -> DataFrame:
    """pages with captured_at, made from page_id where the table has no such timestamps."""
    if dict(pages.dtypes).get("captured_at") in ("timestamp", "timestamp_ntz", "date"):
        return pages.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(100_000_000))
    return pages.withColumn("captured_at", F.timestamp_seconds(seconds))


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, captured_at, html, payload_bytes, payload_digest, record_type, refers_to.

    Digests that repeat are found by an aggregation of digests alone. Pages meet them by a broadcast, or
    beyond its bound by digest and salt; those below ``MIN_REVISIT_BYTES`` meet none and are spread.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = dated(pages).select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), "captured_at", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )
    firsts = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
    firsts = store(firsts.where(F.col("copies") > 1).select(F.col("payload_digest").alias("digest"), "first_page"))
    large = F.col("payload_bytes") >= MIN_REVISIT_BYTES
    if firsts.count() <= BROADCAST_DIGESTS:
        found = rows.join(F.broadcast(firsts), large & (F.col("payload_digest") == F.col("digest")), "left")
    else:
        salted = rows.withColumn("key", F.when(large, F.col("payload_digest")).otherwise(F.lit("")))
        salted = salted.withColumn("salt", F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(F.xxhash64("page_id", "url")))
        found = salted.join(firsts.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), (F.col("key") == F.col("digest")) & (F.col("salt") == F.col("of")), "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return found.select("page_id", "url", "captured_at", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_page")).alias("refers_to"))


# ---------------------------------------------------------------- writing

def make_record(page_id: int | None, url: str, date: str, payload: bytes, payload_bytes: int, digest: str, record_type: str, refers_to: int | None) -> bytes:
    name = lambda page, *more: uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(map(str, (page, *more)))).urn
    plain = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{name(page_id, url, date)}>"), ("WARC-Date", date), ("WARC-Target-URI", plain), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", payload_bytes)]
    if plain != url:
        fields.append(("X-Target-URI-Base64", b64encode(url.encode()).decode()))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if record_type == "revisit":
        block = b""
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers_to)]
    else:
        block = HTTP % len(payload) + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def _members(record: bytes) -> bytes:
    """The record as a gzip member, or as several if it is long."""
    out = []
    for lo in range(0, len(record), MEMBER_BYTES):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(pack.compress(record[lo : lo + MEMBER_BYTES]) + pack.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the records of ``pages`` as WARC files below ``path``.

    Text files hold the bytes of a string as they are, and a separator after each. A gzip member ends with
    the length of its data in four bytes, of which the last is 0 below 16 MB: that byte is the separator.
    """
    rows = classify(pages).select("page_id", "url", F.date_format(F.coalesce("captured_at", F.timestamp_seconds(F.lit(EPOCH))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.when(F.col("record_type") == "response", F.col("html").cast("binary")).alias("payload"), "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batches):
        for batch in batches:
            made, held = [], 0
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made.append(_members(make_record(*(row[c] if c != "payload" else row[c] or b"" for c in rows_columns)))[:-1])
                held += len(made[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])
                    made, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    rows_columns = rows.columns
    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\u0000").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    spark = pages.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.gz"))


# ---------------------------------------------------------------- reading

class _File(io.RawIOBase):
    """A file whose first bytes tell whether it is plain, and that counts what is read."""

    def __init__(self, file):
        self._file, self._head = file, file.read(2)
        self.is_plain, self.size = self._head != b"\x1f\x8b", 0

    def read(self, size: int = -1) -> bytes:
        data, self._head = self._head, b""
        data += self._file.read(size - len(data))
        self.size += len(data)
        return data


def _pieces(file: _File, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(where its gzip member starts, data) of consecutive pieces; a file that isn't compressed counts as one member."""
    data, at = file.read(size), 0
    if file.is_plain:
        while data:
            yield 0, data
            data = file.read(size)
        return
    while data:
        unpack, start = zlib.decompressobj(31), at
        while not unpack.eof:
            if not data:
                data = file.read(size)
            try:
                out = unpack.decompress(data, size) if data else unpack.flush()
            except zlib.error as e:
                raise ValueError(f"damaged WARC file: {e}") from e
            if not data and not unpack.eof:
                raise ValueError("damaged WARC file: it ends within a gzip member")
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            at, data = at + len(data) - len(left), left
            if out:
                yield start, out
        data = data or file.read(size)
        while data[:1] == b"\0":  # some makers pad members
            at += len(data) - len(data.lstrip(b"\0"))
            data = data.lstrip(b"\0") or file.read(size)


def parse_warc(file: _File) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of each record; one record is held at a time.

    Offset and length are those of the record's gzip members, or of its bytes in a file that isn't compressed. In
    a file that is compressed as a whole all records have the offset of that one member and, but for the last, length 0.
    """
    held, members, passed = bytearray(), [], 0  # members: (place in held, place in the file)
    pieces = _pieces(file)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        if not members or members[-1][1] != piece[0]:
            members.append((len(held), piece[0]))
        held.extend(piece[1])
        return True

    def drop(n: int) -> None:
        nonlocal passed
        del held[:n]
        passed += n
        members[:] = [(at - n, where) for at, where in members]

    def here() -> int:
        """The file's offset of the next byte."""
        while len(members) > 1 and members[1][0] <= 0:
            del members[0]
        return passed if file.is_plain else members[0][1]

    waiting = None
    while True:
        while not held or held[0] in b"\r\n":  # line ends after a record
            if held:
                drop(len(held) - len(held.lstrip(b"\r\n")))
            elif not more():
                if waiting:
                    yield waiting
                return
        offset = here()
        while (head := held.find(END)) < 0:
            if not more():
                raise ValueError(f"damaged WARC file: it ends within the head of the record at {offset}")
        if not held.startswith(b"WARC/"):
            raise ValueError(f"damaged WARC file: no record at {offset}")
        fields: dict[str, str] = {}
        for line in held[:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"damaged WARC file: no length of the record at {offset}")
        size = int(fields["content-length"])
        while len(held) < head + 4 + size:
            if not more():
                raise ValueError(f"damaged WARC file: it ends within the record at {offset}")
        block = bytes(held[head + 4 : head + 4 + size])
        drop(head + 4 + size)
        if waiting:
            yield (waiting[0], offset - waiting[0], *waiting[2:])
        waiting = offset, 0, fields, block


RECORDS = "page_id long, url string, captured_at string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, length long"


def _record_row(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    payload = block
    if fields.get("content-type", "").replace(" ", "").startswith("application/http") and block:
        payload = block.partition(END)[2]
    kind, claimed = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        size, digest, payload = int(fields["x-payload-length"]) if "x-payload-length" in fields else None, claimed[2] or None, None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if claimed[0].lower() == "sha256" and claimed[2].lower() != digest:
            raise ValueError(f"damaged WARC record at {offset} in {archive}: the payload isn't that of its digest")
    url = fields.get("warc-target-uri", "").strip("<>")
    if "x-target-uri-base64" in fields:
        url = b64decode(fields["x-target-uri-base64"]).decode()
    number = lambda name: int(fields[name]) if name in fields else None
    return number("x-page-id"), url, fields.get("warc-date"), kind, number("x-refers-to-page"), size, digest, payload if with_payload else None, archive, offset, length


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the WARC files below ``path`` (or of one file), by any maker: ``RECORDS``. A damaged file raises an error."""
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def rows(archive: str, source) -> Iterator[pa.RecordBatch]:
        file, held, size = _File(source), [], 0
        for offset, length, fields, block in parse_warc(file):
            if not length:  # the last record goes to the end of the file
                length = file.size - offset
            held.append(_record_row(archive, offset, length, fields, block, with_payload))
            size += len(block) + 500
            if size > 1 << 22:
                yield batch_of(held)
                held, size = [], 0
        yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        columns = list(zip(*held, strict=True)) if held else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, types[f.split()[1]]) for c, f in zip(columns, RECORDS.split(", "), strict=True)], names=names)

    def whole(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows(batch.column("path")[i].as_py(), io.BytesIO(batch.column("content")[i].as_py()))

    def streamed(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                files, inner = pyarrow.fs.FileSystem.from_uri(name)
                with files.open_input_stream(inner, compression=None) as source:
                    yield from rows(name, source)

    files = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike(r"/[._][^/]*$"))
    small = files.where(F.col("length") <= WHOLE_FILE).select("path", "content").mapInArrow(whole, RECORDS)
    large = files.where(F.col("length") > WHOLE_FILE).select("path")
    if large.isEmpty():
        return small
    return small.unionByName(large.repartition(large.count()).mapInArrow(streamed, RECORDS))


def url_key(url: Column) -> Column:
    """The URL in sortable form: host labels reversed, then a port, without scheme, user and leading www, then path and query."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    place = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#]*)", 1), r"^[Ww]{3}\d*\.", ""))
    port = F.regexp_extract(place, r"(:\d*)$", 1)
    host = F.regexp_replace(place, r":\d*$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest)


class LoserTree:
    """Merges k sorted sequences: each inner node holds the loser of its match, the winner goes on.

    Taking the smallest item and replaying its path costs log2(k) comparisons. Equal keys leave in
    the order of their sequences.
    """

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self._runs = [iter(r) for r in runs]
        self._size = max(1, len(self._runs))
        self._heads = [next(r, None) for r in self._runs] or [None]
        self._losers = [-1] * self._size
        for leaf in range(self._size):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self._size) // 2
        while node > 0:
            other = self._losers[node]
            if other < 0:  # only while the tree is filled: wait here for the opponent
                self._losers[node] = winner
                return
            if self._before(other, winner):
                self._losers[node], winner = winner, other
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (item := self._heads[self._losers[0]]) is not None:
            winner = self._losers[0]
            yield item
            self._heads[winner] = next(self._runs[winner], None)
            self._replay(winner)


KEY = ("url_key", "captured_at", "page_id")
#: Makes every key different: where the record lies.
PLACE = ("archive", "offset")


def merge_runs(runs: DataFrame, rows_a_task: int = MERGE_ROWS) -> DataFrame:
    """Merge rows that are sorted by KEY and PLACE within each run (column ``run``) into one global order."""
    count, room = runs.count(), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-count // rows_a_task), min(room, -(-count // 10_000)))
    columns = [c for c in runs.columns if c != "run"]
    schema = runs.select(*columns).schema

    def merge(batches):
        pieces: dict[int, list] = {}
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            at = len(rows)
            rows.append(batch)
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEY, *PLACE)), strict=True)
            for i, (run, (url, when, page, *place)) in enumerate(zip(batch.column("run").to_pylist(), keys, strict=True)):
                item = (url, when or "", page is not None, page or 0, *place, at, i)
                mine = pieces.setdefault(run, [[]])
                if mine[-1] and item < mine[-1][-1]:  # pieces of a run may arrive in any order
                    mine.append([])
                mine[-1].append(item)
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        first = [0]
        for r in rows:
            first.append(first[-1] + r.num_rows)
        order = [first[x[-2]] + x[-1] for x in LoserTree([p for mine in pieces.values() for p in mine])]
        yield from table.select(columns).take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)

    return runs.repartitionByRange(parts, *KEY, *PLACE).mapInArrow(merge, schema)


@tidy
def capture_index(records: DataFrame) -> DataFrame:
    """Globally ordered index of records as read_archives() gives them; records without a URL (as warcinfo) aren't captures."""
    entries = records.where("record_type IN ('response', 'revisit', 'resource')").select(url_key(F.col("url")).alias("url_key"), "captured_at", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")
    runs = entries.sortWithinPartitions(*KEY, *PLACE).withColumn("run", F.spark_partition_id())
    return merge_runs(store(runs))


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC below ``path`` (the shared folder, if None), read it back, return its index."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_index(read_archives(spark, path, with_payload=False))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_index(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
