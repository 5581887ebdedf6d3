"""Form fields: the field tree, filling, and the XFDF exchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.trees import nearest_ancestor, paths

READ_ONLY = 1


def field_rows(nodes: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """(keys, id, name, field_type, value): the terminal fields of a field tree, with full names and inherited attributes.

    nodes: (keys, id, parent, ord, part, field_type, value). Names join with dots; a type or value that a field lacks is
    its nearest ancestor's.
    """
    full = paths(nodes.select(*keys, "id", "parent", "part"), keys, "part")
    full = full.select(*keys, "id", F.array_join("path", ".").alias("name"))
    leaves = nodes.join(nodes.filter("parent is not null").select(*keys, F.col("parent").alias("id")).distinct(), [*keys, "id"], "left_anti").select(*keys, "id")
    kinds = nearest_ancestor(nodes, keys, "field_type").select(*keys, "id", "field_type")
    values = nearest_ancestor(nodes, keys, "value").select(*keys, "id", "value")
    return leaves.join(full, [*keys, "id"]).join(kinds, [*keys, "id"], "left").join(values, [*keys, "id"], "left")


def fill(fields: DataFrame, updates: DataFrame, flatten: bool = False) -> DataFrame:
    """Fields with the first update of their name (doc_id, ord, name, value); flattened ones become read-only."""
    first = updates.groupBy("doc_id", "name").agg(F.min_by("value", "ord").alias("new_value"))
    both = fields.join(first, ["doc_id", "name"], "left").withColumn("value", F.coalesce("new_value", "value")).drop("new_value")
    return both.withColumn("flags", F.col("flags").bitwiseOR(READ_ONLY)) if flatten else both


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def xml_unescape(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def to_xfdf(fields: DataFrame) -> DataFrame:
    """(doc_id, xfdf): one document's fields, in their order, as XFDF."""
    row = F.concat(F.lit('    <field name="'), xml_escape(F.col("name")), F.lit('"><value>'), xml_escape(F.coalesce("value", F.lit(""))), F.lit("</value></field>\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("xml")))), lambda s: s["xml"]), "")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">\n  <fields>\n'
    return fields.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit("  </fields>\n</xfdf>\n")).alias("xfdf"))


def from_xfdf(files: DataFrame) -> DataFrame:
    """(doc_id, ord, name, value) of (doc_id, xfdf) rows; the names of nested fields join with dots.

    Tags are taken one by one: a field opens a name, its end closes it, and the end of a value gives a row for the field
    that was opened last, or for all names open. Comments and declarations are passed over; fields without a value give
    no row, nor does a null file.
    """
    tags = F.regexp_extract_all("xfdf", F.lit(r"(<!--[\s\S]*?-->[^<]*|<[^>]*>[^<]*)"), F.lit(1))
    texts, row = F.array().cast("array<string>"), "array<struct<name:string,value:string>>"
    start = F.struct(texts.alias("open"), F.lit(None).cast("string").alias("name"), F.lit("").alias("text"), F.array().cast(row).alias("rows"))

    def step(s: Column, tag: Column) -> Column:
        head, after = F.regexp_extract(tag, r"^<([^>]*)>", 1), F.regexp_extract(tag, r"([^>]*)$", 1)
        real = ~tag.rlike(r"^<(\?|!--)")
        kind, own = F.regexp_extract(head, r"^/?\s*([^\s/]*)", 1), F.regexp_extract(head, r'name="([^"]*)"', 1)
        ends, empty = head.startswith("/"), head.endswith("/")
        field, value = real & (kind == "field"), real & (kind == "value")
        begun, given = value & ~ends & ~empty, value & ends
        below = F.concat(s["open"], F.array(own))
        still = F.when(field & ends, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).when(field & ~empty, below).otherwise(s["open"])
        name = F.when(field & ~ends, F.array_join(below, ".")).when(begun, F.coalesce(s["name"], F.array_join(s["open"], "."))).when(~given, s["name"])
        text = F.when(field & ~ends | begun, after).otherwise(F.concat(s["text"], after))
        rows = F.when(given & s["name"].isNotNull(), F.concat(s["rows"], F.array(F.struct(s["name"].alias("name"), s["text"].alias("value"))))).otherwise(s["rows"])
        return F.struct(still.alias("open"), name.alias("name"), text.alias("text"), rows.alias("rows"))

    rows = files.select("doc_id", F.posexplode(F.aggregate(tags, start, step, lambda s: s["rows"])).alias("ord", "pair"))
    return rows.select("doc_id", "ord", xml_unescape(F.col("pair.name")).alias("name"), xml_unescape(F.col("pair.value")).alias("value"))


def flattened(widgets: DataFrame) -> DataFrame:
    """(doc_id, ord, flags) of a document's widgets once all its fields are read-only; missing flags count as none."""
    return widgets.select("doc_id", "ord", F.coalesce("flags", F.lit(0)).bitwiseOR(READ_ONLY).alias("flags"))


def permissions(p: Column, revision: Column, encrypted: Column) -> Column:
    """What a document allows, by the bits of its permission number; without encryption everything."""
    bit = lambda n: p.bitwiseAND(1 << (n - 1)) != 0
    new = F.coalesce(revision, F.lit(2)) >= 3
    rights = {
        "print": bit(3),
        "modify_contents": bit(4),
        "copy_extract": bit(5),
        "annotate": bit(6),
        "fill_forms": F.when(new, bit(9)).otherwise(bit(6)),
        "accessibility_extract": F.when(new, bit(10)).otherwise(bit(5)),
        "assemble": F.when(new, bit(11)).otherwise(bit(4)),
        "print_high_quality": F.when(new, bit(12)).otherwise(bit(3)),
    }
    return F.struct(*[(~encrypted | right).alias(name) for name, right in rights.items()])
