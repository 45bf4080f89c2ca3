"""What a decoder yields, and the Spark schema of it."""

from __future__ import annotations

import dataclasses
import unicodedata


@dataclasses.dataclass
class Hint:
    """What a primitive is, by its format or by a detector."""

    kind: str
    level: int | None = None
    depth: int | None = None
    ordered: bool | None = None
    row: int | None = None
    col: int | None = None
    rowspan: int | None = None
    colspan: int | None = None
    url: str | None = None
    text: str | None = None
    confidence: float = 1.0
    detector: str | None = None


@dataclasses.dataclass
class Primitive:
    """One visible element: a text, an image, a line or a rectangle, with its place on a page."""

    kind: str
    page: int
    order: int
    x: float
    y: float
    width: float
    height: float
    content: str | None = None
    font_size: float | None = None
    font_name: str | None = None
    is_bold: bool = False
    is_italic: bool = False
    direction: str = "ltr"
    lang: str | None = None
    data: bytes | None = None
    alt_text: str | None = None
    origin: str = "synthetic"
    space: str = "dom_flow"
    hints: list[Hint] = dataclasses.field(default_factory=list)


@dataclasses.dataclass
class Warning_:
    kind: str
    message: str
    page: int | None = None


@dataclasses.dataclass
class Decoded:
    """A document. page_basis says where the number of pages comes from."""

    format: str
    page_count: int
    page_basis: str
    title: str | None = None
    encrypted: bool = False
    primitives: list[Primitive] = dataclasses.field(default_factory=list)
    warnings: list[Warning_] = dataclasses.field(default_factory=list)


class DecodeError(ValueError):
    """A document that cannot be decoded at all."""


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


HINT = (
    "struct<kind:string,level:int,depth:int,ordered:boolean,row:int,col:int,rowspan:int,colspan:int,url:string,"
    "text:string,confidence:double,detector:string>"
)
PRIMITIVE = (
    "struct<kind:string,page:int,order:int,x:double,y:double,width:double,height:double,content:string,font_size:double,"
    "font_name:string,is_bold:boolean,is_italic:boolean,direction:string,lang:string,data:binary,alt_text:string,"
    f"origin:string,space:string,hints:array<{HINT}>>"
)
NODE = (
    "struct<node_id:int,parent_id:int,depth:int,kind:string,level:int,text:string,row:int,col:int,rowspan:int,colspan:int,"
    "ordered:boolean,x:double,y:double,width:double,height:double,confidence:double,source:string,page_start:int,"
    "page_end:int,metadata:map<string,string>>"
)
WARNING = "struct<kind:string,message:string,page:int>"
