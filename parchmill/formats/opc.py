"""Office files: a ZIP of XML parts tied together by relations."""

from __future__ import annotations

import posixpath
import zipfile
from typing import BinaryIO
from xml.etree import ElementTree as ET


def local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


class Package:
    """`root` is the tag the main part must have, so that a slide deck under the
    name of a Word document is an error and not an empty text."""

    def __init__(self, source: BinaryIO, root: str):
        self.zip = zipfile.ZipFile(source)
        self.names = set(self.zip.namelist())
        mains = [t for kind, t in self.relations("").values() if kind == "officeDocument"]
        if not mains:
            raise ValueError("no main part")
        self.main = mains[0]
        with self.open(self.main) as part:
            found = local(next(ET.iterparse(part, ("start",)))[1].tag)
        if found != root:
            raise ValueError(f"main part is a {found}, not a {root}")

    def open(self, part: str) -> BinaryIO:
        return self.zip.open(part)

    def xml(self, part: str) -> ET.Element:
        return ET.fromstring(self.zip.read(part))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (last word of the relation type, target part)."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", name + ".rels")
        if rels not in self.names:
            return {}
        found = {}
        for rel in self.xml(rels):
            if rel.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join("/" + folder, rel.get("Target")))
                found[rel.get("Id")] = (rel.get("Type").rpartition("/")[2], target.lstrip("/"))
        return found

    def by_relation(self, part: str, elements: list[ET.Element]) -> list[tuple[str, str]]:
        """(type, target) for elements that carry an r:id attribute, in order."""
        rels = self.relations(part)
        ids = (next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in elements)
        return [rels[i] for i in ids]
