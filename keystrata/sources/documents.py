"""One valid component document (JSON or XML) out of tables, written whole or not at all.

The document is a table of texts in order: the header, for each component what stands before
and behind its occurrences, one text for each occurrence, and the footer. No row holds more
than one component without its occurrences, however many of those there are. The rows are
dealt by reference and sorted once; commas and closings are put between them where the lines
are written, as part files, of which each is a stretch of the document. The commit step then
names the parts in order, streams their bytes one after the other to a temporary name in the
target's folder (a single file has a single writer; nothing is held in memory), sees that all
bytes are there and renames the result. Whatever fails before that leaves no document behind.

A compressed document is one gzip file that any tool unpacks. It is made of members of whole
components; a mark of the document in the comment of each member's header lets Spark's text
source cut the file, so it is read by many tasks as an uncompressed one is.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.components import NAMESPACE
from keystrata.operators.quality import validate_header
from keystrata.session import checkpoint_folder, checkpointed
from keystrata.sources.tables import component_json, component_xml

_HEADER, _COMPONENTS, _FOOTER = 0, 1, 2
_OPEN, _OCCURRENCE = 0, 1
_CLOSING = "]}}"  # of a component in JSON
_ENDS = {"json": f"\n{_CLOSING}\n", "xml": "</component>\n"}  # of a component's last line
_MEMBER = 1 << 20  # bytes of text after which a member ends with its component
_GZIP = bytes([31, 139, 8, 16, 0, 0, 0, 0, 0, 255])  # a member's header up to its comment
_MARK = "keystrata-"  # with an id behind it, the comment
_LAST = bytes([0, 3, 0]) + bytes(8)  # what follows the last mark: an empty member


class InvalidDocument(ValueError):
    """Raised before anything is written where a document would not be valid."""


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _header(header: DataFrame, fmt: str) -> DataFrame:
    tool = F.struct(F.col("tool_type").alias("type"), F.col("tool_name").alias("name"), F.col("tool_version").alias("version"))
    if fmt == "json":
        whole = F.to_json(F.struct(
            F.col("bom_format").alias("bomFormat"), F.col("spec_version").alias("specVersion"), F.col("serial_number").alias("serialNumber"), "version",
            F.struct("timestamp", F.struct(F.array(tool).alias("components")).alias("tools")).alias("metadata")))
        text = F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"components":['))
    else:
        text = F.concat(
            F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<bom xmlns="{NAMESPACE}" serialNumber="'), _escaped(F.col("serial_number")), F.lit('" version="'), F.col("version").cast("string"), F.lit('">\n<metadata>'),
            F.coalesce(F.concat(F.lit("<timestamp>"), F.col("timestamp"), F.lit("</timestamp>")), F.lit("")), F.lit('<tools><components><component type="'), _escaped(F.col("tool_type")), F.lit('"><name>'),
            _escaped(F.col("tool_name")), F.lit("</name><version>"), _escaped(F.col("tool_version")), F.lit("</version></component></components></tools></metadata>\n<components>"))
    return header.select(text.alias("text"))


def _components(components: DataFrame, fmt: str) -> DataFrame:
    """bom_ref with what stands before and after its occurrences."""
    if fmt == "json":
        rows = component_json(components)
        record = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "evidence")))
        return rows.select(F.col("`bom-ref`").alias("bom_ref"), F.concat(F.regexp_replace(record, r"\}$", ""), F.lit(',"evidence":{"occurrences":[')).alias("opening"), F.lit(_CLOSING).alias("closing"))
    rows = component_xml(components)
    xml = lambda *c: F.to_xml(F.struct(*(F.col(f"`{x}`") for x in c)), {"rowTag": "component"})
    front, back = xml("_type", "_bom-ref", "name", "properties"), xml("cryptoProperties")
    return rows.select(
        F.col("`_bom-ref`").alias("bom_ref"), F.concat(F.regexp_replace(front, r"\s*</component>\s*$", ""), F.lit("\n<evidence><occurrences>")).alias("opening"),
        F.concat(F.lit("</occurrences></evidence>"), F.regexp_replace(back, r"^\s*<component>", "")).alias("closing"))


def _occurrences(occurrences: DataFrame, fmt: str) -> DataFrame:
    """bom_ref, place in the component's list, and text, of each occurrence."""
    order = {"location": F.col("location"), "emit_seq": F.lpad(F.col("emit_seq").cast("string"), 20, "0"), "finding_id": F.col("finding_id")}
    place = F.concat_ws("\u0001", *(F.coalesce(c, F.lit("")) for n, c in order.items() if n in occurrences.columns))
    row = F.struct("location", "line", "symbol")
    text = F.to_json(row) if fmt == "json" else F.to_xml(row, {"rowTag": "occurrence"})
    return occurrences.where("bom_ref is not null").select("bom_ref", place.alias("place"), text.alias("text"))


_ORDER = ["part", "bom_ref", "section", "place", "text"]


def document_rows(header: DataFrame, components: DataFrame, occurrences: DataFrame, fmt: str = "json") -> DataFrame:
    """(part, bom_ref, section, place, text, closing): what the document is written from, in
    the order of all columns but the last; ``closing`` stands behind a component's occurrences.
    ``occurrences`` (bom_ref, location, line, symbol and what orders them: emit_seq,
    finding_id) are all listed, but for those of no component; a component without any has an
    empty list. References must be unique."""
    if fmt not in ("json", "xml"):
        raise ValueError(f"no such format: {fmt}")
    lowest = components.agg(F.min("bom_ref")).first()[0] if fmt == "json" else None
    begins = F.lit("") if lowest is None else F.when(F.col("bom_ref") == lowest, "").otherwise(",")

    def rows(df: DataFrame, part: int, section: int, text: Column, ref: Column, place: Column, closing: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), ref.alias("bom_ref"), F.lit(section).alias("section"), place.alias("place"), text.alias("text"), closing.alias("closing"))

    blank, none, ref = F.lit(""), F.lit(None).cast("string"), F.col("bom_ref")
    return (
        rows(_header(header, fmt), _HEADER, 0, F.col("text"), blank, blank, none)
        .unionByName(rows(_components(components, fmt), _COMPONENTS, _OPEN, F.concat(begins, "opening"), ref, blank, F.col("closing")))
        .unionByName(rows(_occurrences(occurrences, fmt), _COMPONENTS, _OCCURRENCE, F.col("text"), ref, F.col("place"), none))
        .unionByName(rows(header, _FOOTER, 0, F.lit("]}" if fmt == "json" else "</components>\n</bom>"), blank, blank, none))
    )


def _lines(batches: Iterable[pa.RecordBatch], comma: str) -> Iterator[tuple[list[str], int]]:
    """The document's lines out of a stretch of its rows, batch by batch, and how many of a
    batch's lines go up to the end of its last component."""
    ref = closing = None
    goes_on = ""
    for batch in batches:
        out, whole = [], 0
        for part, bom_ref, section, text, behind in zip(*(batch.column(n).to_pylist() for n in ("part", "bom_ref", "section", "text", "closing")), strict=True):
            if part == _COMPONENTS and section == _OCCURRENCE:
                if bom_ref == ref:  # else no component has it
                    out.append(goes_on + text)
                    goes_on = comma
                continue
            if closing is not None:
                out.append(closing)
                whole = len(out)
            ref, closing, goes_on = bom_ref, behind, ""
            out.append(text)
        yield out, whole
    if closing is not None:
        yield [closing], 1


def _plain(comma: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, _ in _lines(batches, comma):
            yield pa.RecordBatch.from_arrays([pa.array([x.encode() for x in lines], pa.binary())], names=["value"])

    return of


class _Member:
    """A gzip member from behind its mark, and the header of the next up to its mark."""

    def __init__(self):
        self.packer, self.pieces, self.size, self.crc = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS), [], 0, 0

    def add(self, lines: list[str]) -> None:
        data = "".join(x + "\n" for x in lines).encode()
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self.pieces.append(self.packer.compress(data))

    def row(self) -> pa.RecordBatch:
        tail = self.crc.to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little")
        value = b"".join((b"\0", *self.pieces, self.packer.flush(), tail, _GZIP))
        return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])


def _packed(comma: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members of whole components, behind each of which stands the mark of the next."""
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = _Member()
        for lines, whole in _lines(batches, comma):
            member.add(lines[:whole])
            if whole and member.size >= _MEMBER:
                yield member.row()
                member = _Member()
            member.add(lines[whole:])
        if member.size:
            yield member.row()

    return of


def _checked(header: DataFrame, components: DataFrame) -> None:
    """Raises where the document would have no or several headers, an invalid one, or a
    reference that is missing or not unique."""
    head = header.withColumns({"has_metadata": F.lit(True), "has_tools": F.lit(True), "has_components": F.lit(True)})
    rules = [r["rule"] for r in validate_header(head).where("severity = 'error'").collect()]
    if rules or header.count() != 1:
        raise InvalidDocument(f"header: {', '.join(rules) or 'not one row'}")
    # Hashes of references tell almost always that none comes twice; whole ones are dealt only where they do not.
    twice = components.groupBy(F.xxhash64("bom_ref").alias("hash")).agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("bom_ref") == "", F.lit(True))).alias("blank"))
    if twice.where("n > 1 or blank").isEmpty():
        return
    again = components.groupBy("bom_ref").count().where("bom_ref is null or bom_ref = '' or count > 1").agg(F.count("*"), F.min("bom_ref")).first()
    if again[0]:
        raise InvalidDocument(f"{again[0]} references that are missing or not unique, such as {again[1]!r}")


def joined(spark: SparkSession, folder: str, path: str, size: int, first: bytes = b"", last: bytes = b"") -> None:
    """The commit step: part files of a folder (compressed or not), in order, as the one file ``path``, between ``first``
    and ``last``. It appears under its name only when it has ``size`` bytes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    source, target = at(folder), at(path)
    there, fs = source.getFileSystem(conf), target.getFileSystem(conf)
    if not there.exists(at(f"{folder}/_SUCCESS")):
        raise OSError(f"the parts in {folder} are not complete")
    parts = sorted((x.getPath() for x in there.listStatus(source) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    temporary = at(f"{path.rstrip('/')}.{uuid.uuid4()}.tmp")
    try:
        out = fs.create(temporary)
        try:
            out.write(first)
            for part in parts:
                codec = codecs.getCodec(part)
                stream = there.open(part) if codec is None else codec.createInputStream(there.open(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                finally:
                    stream.close()
            out.write(last)
        finally:
            out.close()
        found = fs.getFileStatus(temporary).getLen()
        if found != size:
            raise OSError(f"{found} bytes instead of {size}")
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(temporary, target):
            raise OSError(f"{path} cannot be written")
    finally:
        if fs.exists(temporary):
            fs.delete(temporary, False)


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_bom(header: DataFrame, components: DataFrame, occurrences: DataFrame, path: str, fmt: str = "json", compressed: bool = False) -> int:
    """Writes the document of a header row, components and all their occurrences as the file
    ``path`` (replacing one that is there), packed by gzip if ``compressed``, and says how many
    bytes it has."""
    spark = components.sparkSession
    components = checkpointed(components)
    _checked(header, components)
    folder, mark = f"{checkpoint_folder(spark)}/document-{uuid.uuid4()}", f"{_MARK}{uuid.uuid4().hex}"
    seen, end = Observation(), mark if compressed else "\n"
    # A component is never dealt to two tasks, which would have to know of each other's commas and members.
    rows = document_rows(header, components, occurrences, fmt).repartitionByRange("part", "bom_ref").sortWithinPartitions(*_ORDER)
    lines = rows.drop("place").mapInArrow((_packed if compressed else _plain)("," if fmt == "json" else ""), "value binary")
    written = lines.observe(seen, F.sum(F.octet_length("value").cast("long") + len(end)).alias("bytes")).select(F.col("value").cast("string"))
    written.write.option("compression", "none" if compressed else "gzip").option("lineSep", end).text(folder)
    size = seen.get["bytes"]
    if compressed:
        first = _GZIP + mark.encode()
        size += len(first) + len(_LAST)
        joined(spark, folder, path, size, first, _LAST)
    else:
        joined(spark, folder, path, size)
    _delete(spark, folder)
    return size


def _mark_of(spark: SparkSession, path: str) -> str | None:
    """The mark between the members of a document that ``write_bom`` has packed, else None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytes(stream.readNBytes(len(_GZIP) + len(_MARK) + 32))
    finally:
        stream.close()
    mark = head[len(_GZIP):].decode("latin-1")
    return mark if head.startswith(_GZIP) and mark.startswith(_MARK) else None


def _unpacked(end: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                value = row.as_py()
                if value.startswith(b"\0"):  # the first row is a header only
                    found = zlib.decompressobj(-zlib.MAX_WBITS).decompress(value[1:]).decode()
                    yield pa.RecordBatch.from_arrays([pa.array(found.split(end), pa.string())], names=["text"])

    return of


def _records(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The document's text, cut behind the last line of each component (without its end). What a
    name ending in .gz holds is unpacked by Spark, in one task."""
    mark = None if path.endswith(".gz") else _mark_of(spark, path)
    if mark is None:
        return spark.read.option("lineSep", _ENDS[fmt]).text(path).select(F.col("value").alias("text"))
    members = spark.read.option("lineSep", mark).text(path).select(F.col("value").cast("binary"))
    return members.mapInArrow(_unpacked(_ENDS[fmt]), "text string")


def read_bom(spark: SparkSession, path: str, component: str, header: str = "bomFormat string, specVersion string, version int") -> DataFrame:
    """(header, component): the components of a JSON document that ``write_bom`` wrote, read in
    stretches by many tasks, with the header beside each. The line that closes a component
    ends a record; a line end inside a value is always escaped, so none is cut."""
    records = _records(spark, path, "json")
    first = F.startswith("text", F.lit('{"bomFormat":'))
    head = records.where(first).select(F.from_json(F.concat(F.substring_index("text", "\n", 1), F.lit("]}")), header).alias("header"))
    body = F.when(first, F.regexp_replace("text", r"^[^\n]*\n?", "")).otherwise(F.col("text"))
    body = records.select(body.alias("text")).where(~F.col("text").rlike(r"^\s*(\]\}\s*)?$"))
    found = body.select(F.from_json(F.concat(F.regexp_replace("text", "^,", ""), F.lit(_CLOSING)), component).alias("component"))
    return F.broadcast(head).crossJoin(found)


def read_bom_xml(spark: SparkSession, path: str, component: str) -> DataFrame:
    """(component): the components of an XML document that ``write_bom`` wrote, read in stretches
    by many tasks. A value's angle brackets are always escaped, so none is cut."""
    records = _records(spark, path, "xml")
    first = F.startswith("text", F.lit("<?xml"))
    body = F.when(first, F.regexp_replace("text", r"(?s)^.*?\n<components>\n", "")).otherwise(F.col("text"))
    body = records.select(body.alias("text")).where(~F.col("text").rlike(r"^\s*(</components>\s*</bom>\s*)?$"))
    return body.select(F.from_xml(F.concat("text", F.lit("</component>")), component).alias("component"))
