"""Shredding of XML text into the node table, in parallel over documents.

The parser is expat, fed by Arrow batches. Limits and refusals (DOCTYPE unless allowed, depth, size, number of nodes,
well-formedness) give an error row for the document instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborist.xdm import ATTRIBUTE, COLUMNS, COMMENT, DOCUMENT, ELEMENT, NAMESPACE, NODE, PI, TEXT, XML, XdmError


@dataclass(frozen=True)
class Limits:
    """What a document may be, and how it is read."""

    allow_doctype: bool = False
    depth: int = 1000
    size: int = 64 << 20
    nodes: int = 10_000_000
    expansion: int = 1 << 20
    positions: bool = False
    strip: frozenset[str] = field(default_factory=frozenset)  # local names whose white-space-only text goes; "*" for all
    preserve: frozenset[str] = field(default_factory=frozenset)  # local names that "*" in strip does not reach


_DECLARATION = re.compile(rb"""^(<\?xml\b[^>]*?\bversion\s*=\s*["'])1\.1(["'])""")
_ENCODING = re.compile(rb"""^(<\?xml\b[^>]*?)\s+encoding\s*=\s*(?:"[^"]*"|'[^']*')""")


def decoded(data: bytes) -> bytes:
    """The document as UTF-8: byte order marks tell UTF-8 and UTF-16, XML 1.1 is read as 1.0."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            data = data[len(mark) :].decode(name).encode()
            data = _ENCODING.sub(rb"\1", data)
            break
    return _DECLARATION.sub(rb"\g<1>1.0\2", data)


class _Builder:
    """Rows of one document, appended as expat reports them."""

    def __init__(self, limits: Limits, uri: str | None) -> None:
        self.limits, self.uri = limits, uri
        self.rows: list[list] = []
        self.open: list[int] = []
        self.text: list[str] = []
        self.scopes: list[dict[str, str]] = [{"xml": XML}]
        self.defaults: dict[str, list[tuple[str, str]]] = {}
        self.expanded = 0
        self.where = lambda: (None, None)
        self._add(DOCUMENT, "", None, "", None)
        self.open.append(0)

    def _add(self, kind: int, uri: str, local: str | None, prefix: str, value: str | None) -> int:
        pre = len(self.rows)
        if pre >= self.limits.nodes:
            raise XdmError("FODC0006", f"more than {self.limits.nodes} nodes")
        parent = self.open[-1] if self.open else None
        line, col = self.where() if self.limits.positions else (None, None)
        path = self.rows[parent][13] if parent is not None else ""
        if kind == ELEMENT:
            path = f"{path}/{local}"
        elif kind == ATTRIBUTE:
            path = f"{path}/@{local}"
        self.rows.append([pre, pre, len(self.open), parent, kind, uri, local, prefix, value, None, self.uri, line, col, path])
        return pre

    def flush(self) -> None:
        if self.text:
            text = "".join(self.text)
            self.text = []
            parent = self.rows[self.open[-1]]
            if len(self.open) == 1:
                return
            strip = self.limits.strip
            if strip and not text.strip(" \t\r\n") and (parent[6] in strip or ("*" in strip and parent[6] not in self.limits.preserve)):
                return
            self._add(TEXT, "", None, "", text)

    def _name(self, name: str, attribute: bool) -> tuple[str, str, str]:
        prefix, _, local = name.rpartition(":")
        if not prefix and attribute:
            return "", local, ""
        uri = self.scopes[-1].get(prefix)
        if uri is None:
            if prefix:
                raise XdmError("FODC0006", f"undeclared prefix {prefix}")
            uri = ""
        return uri, local, prefix

    def start(self, name: str, attributes: list[str]) -> None:
        self.flush()
        if len(self.open) > self.limits.depth:
            raise XdmError("FODC0006", f"deeper than {self.limits.depth}")
        pairs = list(zip(attributes[::2], attributes[1::2], strict=True))
        given = {k for k, _ in pairs}
        pairs += [(k, v) for k, v in self.defaults.get(name, ()) if k not in given]
        declared = {k[6:] if k != "xmlns" else "": v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        self.scopes.append(self.scopes[-1] | declared if declared else self.scopes[-1])
        uri, local, prefix = self._name(name, False)
        pre = self._add(ELEMENT, uri, local, prefix, None)
        self.open.append(pre)
        for p in sorted(declared):
            self._add(NAMESPACE, "", p, "", declared[p])
        seen = set()
        for k, v in pairs:
            if k != "xmlns" and not k.startswith("xmlns:"):
                a = self._name(k, True)
                if a[:2] in seen:
                    raise XdmError("FODC0006", f"attribute {k} is repeated")
                seen.add(a[:2])
                self._add(ATTRIBUTE, *a, v)

    def end(self, _: str) -> None:
        self.flush()
        self.scopes.pop()
        pre = self.open.pop()
        rows = self.rows
        rows[pre][1] = len(rows) - 1
        inside = [r for r in rows[pre + 1 :] if r[3] == pre and r[4] in (ELEMENT, TEXT)] if len(rows) - pre < 64 else None
        if inside is not None and all(r[4] == TEXT for r in inside):
            rows[pre][8] = "".join(r[8] for r in inside)
        elif inside is None and not any(r[4] == ELEMENT for r in rows[pre + 1 :]):
            rows[pre][8] = "".join(r[8] for r in rows[pre + 1 :] if r[4] == TEXT)

    def comment(self, data: str) -> None:
        self.flush()
        self._add(COMMENT, "", None, "", data)

    def instruction(self, target: str, data: str) -> None:
        self.flush()
        self._add(PI, "", target, "", data)

    def doctype(self, *_) -> None:
        if not self.limits.allow_doctype:
            raise XdmError("FODC0006", "DOCTYPE is not allowed")

    def attlist(self, element: str, name: str, _kind: str, default: str | None, _required: int) -> None:
        if default is not None:
            self.defaults.setdefault(element, []).append((name, default))

    def data(self, text: str) -> None:
        self.expanded += len(text)
        self.text.append(text)

    def finish(self) -> list[list]:
        self.rows[0][1] = len(self.rows) - 1
        return self.rows


def parse(data: bytes | str, limits: Limits = Limits(), uri: str | None = None) -> list[list]:
    """The node rows of one document (without doc_id); raises XdmError with code FODC0006 where it is refused."""
    data = data.encode() if isinstance(data, str) else data
    if len(data) > limits.size:
        raise XdmError("FODC0006", f"larger than {limits.size} bytes")
    built = _Builder(limits, uri)
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.specified_attributes = True
    parser.buffer_text = True
    built.where = lambda: (parser.CurrentLineNumber, parser.CurrentColumnNumber + 1)
    parser.StartElementHandler, parser.EndElementHandler = built.start, built.end
    parser.CharacterDataHandler, parser.CommentHandler = built.data, built.comment
    parser.ProcessingInstructionHandler, parser.StartDoctypeDeclHandler = built.instruction, built.doctype
    parser.AttlistDeclHandler = built.attlist
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    try:
        parser.Parse(decoded(data), True)
    except expat.ExpatError as e:
        raise XdmError("FODC0006", str(e)) from None
    except (UnicodeDecodeError, ValueError) as e:
        raise XdmError("FODC0006", f"encoding: {e}") from None
    if built.expanded > len(data) + limits.expansion:
        raise XdmError("FODC0006", "entities expand beyond the limit")
    return built.finish()


_ROWS = "doc_id bigint, pre int, last int, level int, parent int, kind int, uri string, local string, prefix string, value string, type_ann string, base_uri string, line int, col int, name_path string, error string"


def shred(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", uri_col: str | None = None, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(node table, error table (doc_id, code, message)) of a string or binary column of documents."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(xml_col).cast("binary").alias("xml"),
        (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"),
    )
    kinds = [f.dataType for f in NODE]
    types = [{"bigint": pa.int64(), "int": pa.int32()}.get(k.simpleString(), pa.string()) for k in kinds] + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, out = whole.slice(at, 64), []
                for d, x, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        out += [(d, *r, None) for r in parse(x or b"", limits, u)]
                    except XdmError as e:
                        out.append((d, *[None] * 14, str(e)))
                columns = list(zip(*out, strict=True)) or [()] * 16
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*COLUMNS, "error"])

    found = rows.mapInArrow(run, _ROWS)
    errors = found.where("error IS NOT NULL").select(
        "doc_id", F.substring_index("error", ": ", 1).alias("code"), F.expr("substring(error, instr(error, ': ') + 2)").alias("message")
    )
    return found.where("error IS NULL").select(*COLUMNS), errors


def read(spark: SparkSession, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Node and error tables of files, each a document; its id is a hash of its path and its base URI the path."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("xml"))
    return shred(files, uri_col="path", limits=limits)


def strip_space(nodes: DataFrame, names: list[str], preserve: list[str] = ()) -> DataFrame:
    """Nodes without white-space-only text whose parent is named (or "*") and not preserved; numbering keeps its gaps."""
    parents = nodes.where(F.col("kind") == ELEMENT).select("doc_id", F.col("pre").alias("parent"), "local")
    chosen = F.lit(True) if "*" in names else F.col("local").isin(list(names))
    if preserve:
        chosen = chosen & ~F.col("local").isin(list(preserve))
    blank = nodes.where((F.col("kind") == TEXT) & ~F.col("value").rlike(r"[^ \t\r\n]"))
    gone = blank.join(parents.where(chosen).drop("local"), ["doc_id", "parent"], "left_semi").select("doc_id", "pre")
    return nodes.join(gone, ["doc_id", "pre"], "left_anti")


def attribute_defaults(nodes: DataFrame, defaults: list[tuple[str, str, str]]) -> DataFrame:
    """Elements lacking an attribute that has a default: (doc_id, pre of the element, local, value) rows to be added."""
    spark = nodes.sparkSession
    table = F.broadcast(spark.createDataFrame(defaults, "element string, local string, value string"))
    wanted = nodes.where(F.col("kind") == ELEMENT).join(table.withColumnRenamed("local", "name").withColumnRenamed("value", "given"), F.col("local") == F.col("element"))
    had = nodes.where(F.col("kind") == ATTRIBUTE).select("doc_id", F.col("parent").alias("pre"), F.col("local").alias("name"))
    return wanted.join(had, ["doc_id", "pre", "name"], "left_anti").select("doc_id", "pre", F.col("name").alias("local"), F.col("given").alias("value"))


Reader = Callable[[str], bytes]


def with_defaults(nodes: DataFrame, defaults: list[tuple[str, str, str]]) -> DataFrame:
    """The nodes with attributes that have a default and are not there, (element, attribute, value) each, numbered anew.

    A new attribute stands behind those that its element has; nodes behind it move on, and so do the ends of subtrees.
    """
    new = attribute_defaults(nodes, defaults).withColumnRenamed("pre", "owner")
    own = nodes.where(F.col("kind").isin(ATTRIBUTE, NAMESPACE)).groupBy("doc_id", F.col("parent").alias("owner")).agg(F.max("pre").alias("behind"))
    holders = nodes.select("doc_id", F.col("pre").alias("owner"), F.col("level").alias("__level"), F.col("name_path").alias("__path"), "base_uri")
    new = new.join(own, ["doc_id", "owner"], "left").join(holders, ["doc_id", "owner"])
    made = {
        "pre": F.lit(None), "last": F.lit(None), "level": F.col("__level") + 1, "parent": F.col("owner"), "kind": F.lit(ATTRIBUTE), "uri": F.lit(""), "prefix": F.lit(""),
        "name_path": F.concat("__path", F.lit("/@"), "local"),
    }
    shape = nodes.select(*COLUMNS).schema
    columns = [made.get(f.name, F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]
    rows = nodes.select(*COLUMNS, F.col("pre").alias("__at"), F.lit(0).alias("__new")).unionByName(
        new.select(*columns, F.coalesce("behind", "owner").alias("__at"), F.lit(1).alias("__new"))
    )
    line = Window.partitionBy("doc_id").orderBy("__at", "__new", "local")
    more = F.sum("__new").over(Window.partitionBy("doc_id", "__at"))
    rows = rows.withColumn("__pre", (F.row_number().over(line) - 1).cast("int")).withColumn("__more", more)
    places = rows.where("__new = 0").select("doc_id", F.col("pre").alias("__old"), F.col("__pre").alias("__to"), (F.col("__pre") + F.col("__more")).cast("int").alias("__end"))
    parents = places.select("doc_id", F.col("__old").alias("parent"), F.col("__to").alias("__parent"))
    ends = places.select("doc_id", F.col("__old").alias("last"), F.col("__end").alias("__last"))
    rows = rows.join(parents, ["doc_id", "parent"], "left").join(ends, ["doc_id", "last"], "left")
    # an attribute or text ends where it stands, even if new attributes follow it
    leaf = F.col("last").isNull() | ((F.col("last") == F.col("pre")) & (F.col("kind") != ELEMENT))
    moved = {"pre": F.col("__pre"), "parent": F.col("__parent"), "last": F.when(leaf, F.col("__pre")).otherwise(F.col("__last"))}
    return rows.select(*[moved.get(c, F.col(c)).alias(c) for c in COLUMNS])
