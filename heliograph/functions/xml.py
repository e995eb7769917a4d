"""Sidecar documents as trees: properties by the namespace they are in, whatever its prefix.

A namespace is bound to a prefix for the part of a document below its declaration, and may be bound anew further down, which no pattern and no reader
of fixed element names can follow. So each text is parsed by the standard library, a helper per row in Arrow batches; everything behind it is columns.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Namespaces of the standards, and their list properties that are read.
RDF, DC, DIGIKAM = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/dc/elements/1.1/", "http://www.digikam.org/ns/1.0/"
LR, IPTC_EXT = "http://ns.adobe.com/lightroom/1.0/", "http://iptc.org/std/Iptc4xmpExt/2008-02-29/"
MWG_RS, ST_AREA = "http://www.metadataworkinggroup.com/schemas/regions/", "http://ns.adobe.com/xmp/sType/Area#"
LISTS = {f"{{{DC}}}subject": "subject", f"{{{DIGIKAM}}}TagsList": "tags_list", f"{{{LR}}}hierarchicalSubject": "hierarchical_subject", f"{{{IPTC_EXT}}}PersonInImage": "person_in_image"}
REGION = StructType([StructField("name", StringType()), StructField("kind", StringType()), *[StructField(s, DoubleType()) for s in "xywh"]])
VIEW = StructType([*[StructField(c, ArrayType(StringType())) for c in LISTS.values()], StructField("regions", ArrayType(REGION))])


def _items(element: ET.Element) -> list[str]:
    """The trimmed items of a property's containers, or its own text if it has none."""
    items = element.findall(f".//{{{RDF}}}li")
    texts = ["".join(x.itertext()).strip() for x in items] if items else ["".join(element.itertext()).strip()]
    return [t for t in texts if t]


def _value(element: ET.Element, name: str) -> str | None:
    """A property of a structure, written as an attribute or as a child, on the element or on a description within it."""
    for e in (element, *element.findall(f"{{{RDF}}}Description")):
        if name in e.attrib:
            return e.attrib[name].strip()
        child = e.find(name)
        if child is not None:
            return "".join(child.itertext()).strip()
    return None


def _regions(element: ET.Element) -> list[tuple]:
    """Boxes in parts of the picture: units absent or normalized, all four numbers there."""
    out = []
    for li in element.findall(f".//{{{RDF}}}li"):
        holder = li.find(f".//{{{MWG_RS}}}Area")
        if holder is None or _value(holder, f"{{{ST_AREA}}}unit") not in (None, "", "normalized"):
            continue
        try:
            sides = [float(_value(holder, f"{{{ST_AREA}}}{s}")) for s in "xywh"]
        except (TypeError, ValueError):
            continue
        out.append((_value(li, f"{{{MWG_RS}}}Name") or None, _value(li, f"{{{MWG_RS}}}Type") or None, *sides))
    return out


def view_of(text: str | None) -> tuple | None:
    """(lists in the order of LISTS, regions) of a document; properties that are repeated add up. None if it isn't well-formed or declares a document type."""
    if text is None or "<!DOCTYPE" in text:
        return None
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    lists: dict[str, list[str]] = {c: [] for c in LISTS.values()}
    regions: list[tuple] = []

    def visit(e: ET.Element) -> None:
        for name, value in e.attrib.items():
            if name in LISTS and value.strip():
                lists[LISTS[name]].append(value.strip())
        if e.tag in LISTS:
            lists[LISTS[e.tag]] += _items(e)
        elif e.tag == f"{{{MWG_RS}}}RegionList":
            regions.extend(_regions(e))
            return
        for child in e:
            visit(child)

    visit(root)
    return (*lists.values(), regions)


@F.pandas_udf(VIEW)
def sidecar_view(texts: pd.Series) -> pd.DataFrame:
    """A struct of lists and regions per text; lists are null where the document can't be read."""
    rows = [view_of(t) or (None,) * (len(LISTS) + 1) for t in texts]
    cols = [*LISTS.values(), "regions"]
    out = pd.DataFrame(rows, columns=cols, dtype=object)
    out["regions"] = [None if r is None else [dict(zip(("name", "kind", *"xywh"), x, strict=True)) for x in r] for r in out["regions"]]
    return out
