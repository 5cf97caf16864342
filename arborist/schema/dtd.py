"""DTD validation: declarations are read on the driver, content models become patterns, checks are queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborist.schema.model import Particle, Symbols, pattern
from arborist.xdm import ATTRIBUTE, ELEMENT, TEXT, XdmError


@dataclass
class Dtd:
    """Content (EMPTY, ANY, a particle, or mixed names) of elements and the attributes of each."""

    content: dict[str, object] = field(default_factory=dict)
    attributes: dict[str, dict[str, tuple[str, str, str | None]]] = field(default_factory=dict)  # name -> (type, use, value)
    external: bool = False


def parse_dtd(text: str) -> Dtd:
    """The ELEMENT and ATTLIST declarations of an internal subset or a whole DOCTYPE declaration."""
    out = Dtd(external=bool(re.search(r"<!DOCTYPE\s+\S+\s+(?:SYSTEM|PUBLIC)", text)))
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    for name, model in re.findall(r"<!ELEMENT\s+(\S+)\s+([^>]+)>", text):
        model = model.strip()
        if name in out.content:
            raise XdmError("dtd", f"element {name} is declared twice")
        if model in ("EMPTY", "ANY"):
            out.content[name] = model
        elif "#PCDATA" in model:
            out.content[name] = frozenset(re.findall(r"[^\s|()*#]+", model.replace("#PCDATA", "")))
        else:
            out.content[name], rest = _particle(re.sub(r"\s+", "", model))
            if rest:
                raise XdmError("dtd", f"bad content model {model}")
    for element, body in re.findall(r"<!ATTLIST\s+(\S+)\s+((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", text):
        for m in re.finditer(r"(\S+)\s+(\([^)]*\)|NOTATION\s*\([^)]*\)|\w+)\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"([^\"]*)\"|'([^']*)'))", body):
            use = m[3].split()[0] if m[3].startswith("#") else "default"
            out.attributes.setdefault(element, {}).setdefault(m[1], (m[2], use, m[4] if m[4] is not None else m[5]))
    return out


def _particle(text: str) -> tuple[Particle, str]:
    """A content particle and the text after it."""
    if text.startswith("("):
        parts, rest, sep = [], text[1:], ""
        while True:
            p, rest = _particle(rest)
            parts.append(p)
            if rest.startswith(")"):
                rest = rest[1:]
                break
            if not rest or rest[0] not in ",|" or (sep and rest[0] != sep):
                raise XdmError("dtd", f"bad content model at {rest!r}")
            sep, rest = rest[0], rest[1:]
        made = Particle("choice" if sep == "|" else "sequence", children=parts)
    else:
        m = re.match(r"[^,|()?*+]+", text)
        if m is None:
            raise XdmError("dtd", f"bad content model at {text!r}")
        made, rest = Particle("element", name=("", m[0])), text[m.end() :]
    if rest[:1] in ("?", "*", "+") and rest:
        made.least, made.most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[rest[0]]
        rest = rest[1:]
    return made, rest


def validate(nodes: DataFrame, dtd: Dtd) -> DataFrame:
    """(doc_id, pre, code, path) of violations: content, undeclared, required, fixed, enum, id, idref."""
    symbols = Symbols()
    for name in dtd.content:
        symbols.get(("", name))
    patterns = {n: pattern(m, symbols) for n, m in dtd.content.items() if isinstance(m, Particle)}
    kids = nodes.where(F.col("kind") == ELEMENT).select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("k"), symbols.column().alias("s"))
    words = kids.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "").alias("w"))
    texts = nodes.where(F.col("kind") == TEXT).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.max(F.col("value").rlike(r"[^ \t\r\n]")).alias("t"))
    elements = nodes.where(F.col("kind") == ELEMENT)
    rows = elements.join(words, ["doc_id", "pre"], "left").join(texts, ["doc_id", "pre"], "left")
    word, text = F.coalesce("w", F.lit("")), F.coalesce("t", F.lit(False))
    ok = F.lit(None).cast("boolean")
    for name, model in dtd.content.items():
        if model == "ANY":
            good = ~F.contains(word, F.lit(Symbols.OTHER))
        elif model == "EMPTY":
            good = (word == "") & F.col("t").isNull()
        elif isinstance(model, frozenset):
            good = F.translate(word, "".join(symbols.get(("", n)) for n in model), "") == "" if model else word == ""
        else:
            good = F.rlike(word, F.lit(rf"\A(?:{patterns[name]})\z")) & ~text
        ok = F.when(F.col("local") == name, good).otherwise(ok)
    code = F.when(ok.isNull(), "undeclared-element").when(~ok, "content")
    out = rows.withColumn("code", code).where("code IS NOT NULL").select("doc_id", "pre", "code", F.col("name_path").alias("path"))
    spark = nodes.sparkSession
    declared = [(e, n, t, u, v) for e, attrs in dtd.attributes.items() for n, (t, u, v) in attrs.items()]
    table = F.broadcast(spark.createDataFrame(declared or [("", "", "", "", None)], "local string, name string, type string, use string, fixed string"))
    given = nodes.where(F.col("kind") == ATTRIBUTE).select("doc_id", F.col("parent").alias("pre"), F.col("local").alias("name"), F.col("value").alias("v"))
    owners = elements.select("doc_id", "pre", "local", "name_path")
    on = owners.join(given, ["doc_id", "pre"]).join(table, ["local", "name"], "left")
    allowed = F.split(F.regexp_replace(F.col("type"), r"^(NOTATION)?\s*\(\s*|\s*\)$|\s+", ""), r"\|")
    bad = F.when(F.col("type").isNull(), "undeclared-attribute").when((F.col("use") == "#FIXED") & (F.col("v") != F.col("fixed")), "fixed").when(
        F.contains("type", F.lit("(")) & ~F.array_contains(allowed, F.trim("v")), "enumeration"
    )
    out = out.unionByName(on.withColumn("code", bad).where("code IS NOT NULL").select("doc_id", "pre", "code", F.col("name_path").alias("path")))
    missing = owners.join(table.where("use = '#REQUIRED'"), "local").join(given, ["doc_id", "pre", "name"], "left_anti")
    out = out.unionByName(missing.select("doc_id", "pre", F.lit("required").alias("code"), F.col("name_path").alias("path")))
    ids = on.where("type = 'ID'").select("doc_id", "pre", "name_path", "v")
    again = ids.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "v").orderBy("pre"))).where("k > 1")
    refs = on.where("type IN ('IDREF', 'IDREFS')").select("doc_id", "pre", "name_path", F.explode(F.split(F.trim("v"), r"\s+")).alias("v"))
    lost = refs.join(ids.select("doc_id", "v"), ["doc_id", "v"], "left_anti")
    for df, c in ((again, "id"), (lost, "idref")):
        out = out.unionByName(df.select("doc_id", "pre", F.lit(c).alias("code"), F.col("name_path").alias("path")))
    return out
