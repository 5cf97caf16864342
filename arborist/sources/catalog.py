"""Documents by URI: doc(), doc-available() and collection() as joins with a registered node table, and resolvers."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, build_opener

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.plans.lower import Engine
from arborist.xdm import DOCUMENT, XSI, XdmError


class Catalog:
    """A node table whose documents are known by their base URIs; collections name sets of URIs (None: all)."""

    def __init__(self, nodes: DataFrame, collections: dict[str | None, list[str] | None] | None = None) -> None:
        self.nodes, self.engine = nodes, Engine(nodes)
        self.collections = collections or {}

    def roots(self) -> DataFrame:
        return self.nodes.where(F.col("kind") == DOCUMENT).select(F.col("base_uri").alias("__uri"), F.col("doc_id").alias("target"))

    def documents(self, rows: DataFrame, uri: str) -> DataFrame:
        """rows with target, the document of their URI, null where doc-available() would be false."""
        return rows.join(self.roots(), F.col(uri) == F.col("__uri"), "left").drop("__uri")

    def doc(self, rows: DataFrame, uri: str) -> DataFrame:
        """As documents, but a URI without a document raises FODC0002."""
        found = self.documents(rows, uri)
        missing = F.raise_error(F.concat(F.lit("FODC0002: no document "), F.col(uri))).cast("bigint")
        return found.withColumn("target", F.when(F.col(uri).isNull(), F.lit(None)).otherwise(F.coalesce("target", missing)))

    def collection(self, name: str | None = None) -> DataFrame:
        """(doc_id) of a collection's documents; FODC0002 for one that is not registered."""
        if name not in self.collections:
            raise XdmError("FODC0002", f"no collection {name}")
        members = self.collections[name]
        roots = self.nodes.where(F.col("kind") == DOCUMENT)
        return (roots if members is None else roots.where(F.col("base_uri").isin(members))).select("doc_id")


Resolver = Callable[[str, str | None], bytes]


def map_resolver(table: dict[str, bytes | str]) -> Resolver:
    """Documents of a dictionary."""

    def run(uri: str, base: str | None = None) -> bytes:
        for key in (uri, urljoin(base or "", uri)):
            if key in table:
                value = table[key]
                return value.encode() if isinstance(value, str) else value
        raise XdmError("FODC0002", f"no document {uri}")

    return run


def file_resolver(roots: list[str], most: int = 256) -> Resolver:
    """Files below some folders, links followed before the check; the last `most` are kept."""
    allowed = [os.path.realpath(r) for r in roots]
    kept: dict[str, bytes] = {}

    def run(uri: str, base: str | None = None) -> bytes:
        parts = urlsplit(urljoin(base or "", uri) if base and not os.path.isabs(uri) else uri)
        if parts.scheme not in ("", "file"):
            raise XdmError("FODC0005", f"not a file: {uri}")
        path = os.path.realpath(parts.path if os.path.isabs(parts.path) else os.path.join(allowed[0], parts.path))
        if not any(os.path.commonpath([path, r]) == r for r in allowed):
            raise XdmError("FODC0002", f"{uri} is outside the allowed folders")
        if path not in kept:
            if len(kept) >= most:
                kept.clear()
            try:
                with open(path, "rb") as f:
                    kept[path] = f.read()
            except OSError as e:
                raise XdmError("FODC0002", str(e)) from None
        return kept[path]

    return run


def http_resolver(hosts: list[str], most: int = 8 << 20, timeout: float = 10.0) -> Resolver:
    """Documents of listed hosts; every redirect is checked, size and time are bounded. Nothing uses it by default."""

    class Checked(HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            check(newurl)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    def check(uri: str) -> None:
        parts = urlsplit(uri)
        if parts.scheme not in ("http", "https") or parts.hostname not in hosts:
            raise XdmError("FODC0002", f"{uri} is not of an allowed host")

    def run(uri: str, base: str | None = None) -> bytes:
        whole = urljoin(base or "", uri)
        check(whole)
        with build_opener(Checked).open(whole, timeout=timeout) as answer:
            data = answer.read(most + 1)
        if len(data) > most:
            raise XdmError("FODC0002", f"{uri} is larger than {most} bytes")
        return data

    return run


def unparsed_text(uri: str) -> str:
    """Refused by design."""
    raise XdmError("FOUT1170", f"unparsed text {uri} is not read")


def schema_locations(nodes: DataFrame, namespaces: list[str]) -> DataFrame:
    """(doc_id, namespace, location) hints of xsi:schemaLocation for allowed namespaces."""
    hints = nodes.where((F.col("uri") == XSI) & (F.col("local") == "schemaLocation")).select("doc_id", F.split(F.trim("value"), r"\s+").alias("w"))
    pairs = hints.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 2).cast("int") - 1)).alias("k")).where("size(w) >= 2")
    found = pairs.select("doc_id", F.get("w", 2 * F.col("k")).alias("namespace"), F.get("w", 2 * F.col("k") + 1).alias("location"))
    return found.where(F.col("namespace").isin(namespaces)).distinct()


def validate_by_hints(nodes: DataFrame, namespaces: list[str], resolve: Resolver, most: int = 100) -> DataFrame:
    """The error table of documents that name a schema of an allowed namespace, each by its own; at most `most` schemas.

    Schemas are read by the resolver only; a hint that it does not allow is an error, and so are more than `most` of them.
    """
    from arborist.schema.xsd import Schema, validate

    hints = schema_locations(nodes, namespaces)
    places = [r.location for r in hints.select("location").distinct().orderBy("location").limit(most + 1).collect()]
    if len(places) > most:
        raise XdmError("FODC0002", f"more than {most} schemas are named")
    out = None
    for place in places:
        text = resolve(place, None)
        schema = Schema(text.decode() if isinstance(text, bytes) else text, resolve=resolve)
        found = validate(nodes.join(hints.where(F.col("location") == place).select("doc_id"), "doc_id", "left_semi"), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else nodes.where("false").select("doc_id", "pre", F.lit("").alias("code"), F.lit("").alias("message"), F.col("name_path").alias("path"))
