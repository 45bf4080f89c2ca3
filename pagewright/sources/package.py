"""Parts of an OOXML package, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from xml.etree import ElementTree

from pagewright.sources.model import DecodeError, Warning_


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ElementTree.Element, name: str) -> str | None:
    """By local name, whatever its namespace."""
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def child(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next((c for c in e if local(c.tag) == name), None) if e is not None else None
    return e


def children(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [c for c in e if local(c.tag) == name] if e is not None else []


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError) as e:
            raise DecodeError(f"not a ZIP archive: {e}") from None
        self.names = set(self.zip.namelist())
        self.warnings: list[Warning_] = []

    def read(self, name: str, page: int | None = None) -> bytes | None:
        """A part's bytes; a missing or broken part gives a warning."""
        if name not in self.names:
            self.warnings.append(Warning_("missing_part", f"{name} is missing", page))
            return None
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, OSError, NotImplementedError) as e:
            self.warnings.append(Warning_("malformed_content", f"{name} cannot be read: {e}", page))
            return None

    def xml(self, name: str, page: int | None = None, needed: bool = True) -> ElementTree.Element | None:
        if name not in self.names and not needed:
            return None
        data = self.read(name, page)
        try:
            return None if data is None else ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            self.warnings.append(Warning_("malformed_content", f"{name} is no XML: {e}", page))
            return None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Id to (type's last word, target path or URL, external) of a part."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels", needed=False)
        out = {}
        for r in children(root, "Relationship"):
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target, external)
        return out
