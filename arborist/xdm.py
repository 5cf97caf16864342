"""The node table, the engine's central relation: one row for each node of every document, in document order.

`pre` numbers a document's nodes from 0 in document order (an element, its namespace nodes, its attributes, then its
children), `last` is the largest `pre` in the node's subtree, so n is a descendant of a iff a.pre < n.pre <= a.last.
`value` is the string value of every node but of elements and documents that have element children; those have null
and get it on demand (operators.values.with_string_value).
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Node kinds, as stored.
DOCUMENT, ELEMENT, ATTRIBUTE, TEXT, COMMENT, PI, NAMESPACE = range(7)

KIND_NAMES = ("document-node", "element", "attribute", "text", "comment", "processing-instruction", "namespace")

XS = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
XML = "http://www.w3.org/XML/1998/namespace"
FN = "http://www.w3.org/2005/xpath-functions"

NODE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("uri", T.StringType()),
    T.StructField("local", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("type_ann", T.StringType()),
    T.StructField("base_uri", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("name_path", T.StringType()),
])

COLUMNS = NODE.names


class XdmError(Exception):
    """An error with its code, such as FORG0001 or XPST0003."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
