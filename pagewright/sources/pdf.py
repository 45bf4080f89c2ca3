"""PDF to primitives: texts, ruling lines, images and links of each page, with the standard library."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pagewright.functions.text import RTL_LANGUAGES, language_of_letters
from pagewright.sources.model import DecodeError, Decoded, Hint, Primitive, Warning_, nfc

_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_OBJECT = re.compile(rb"(?:^|[\s>])(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

#: Widest gap within a span, and the drift of the baseline that ends it, in units of the font size.
GAP, DRIFT = 0.3, 0.3

#: Width of a glyph of a font that names none, in thousandths of its size.
PLAIN_WIDTH = 500


class Name(str):
    __slots__ = ()


class Operator(str):
    __slots__ = ()


class Ref(tuple):
    __slots__ = ()


class Stream:
    def __init__(self, head: dict, data: bytes):
        self.head, self.data = head, data


class Lexer:
    """Objects of a stretch of bytes; operators too, in content streams."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 0x25:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def word(self) -> bytes:
        start, d, n = self.at, self.data, len(self.data)
        while self.at < n and d[self.at] not in _SPACE and d[self.at] not in _DELIMITERS:
            self.at += 1
        return d[start : self.at]

    def next(self):
        """The next object; raises EOFError behind the last."""
        self.skip()
        if self.at >= len(self.data):
            raise EOFError
        c = self.data[self.at : self.at + 1]
        if c == b"/":
            self.at += 1
            raw = self.word()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self.literal()
        if self.data[self.at : self.at + 2] == b"<<":
            self.at += 2
            return self.dictionary()
        if c == b"<":
            end = self.data.find(b">", self.at)
            end = len(self.data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(self.data):
                    return out
                if self.data[self.at] == 0x5D:
                    self.at += 1
                    return self.fold(out)
                out.append(self.next())
        if c in b")>]{}":
            self.at += 1
            return Operator(c.decode("latin-1"))
        raw = self.word()
        if re.fullmatch(rb"[+-]?\d+", raw):
            return int(raw)
        if re.fullmatch(rb"[+-]*\d*\.\d*", raw) and raw.strip(b"+-."):
            return float(raw.replace(b"--", b"-"))
        return {b"true": True, b"false": False, b"null": None}.get(raw, Operator(raw.decode("latin-1")))

    @staticmethod
    def fold(items: list) -> list:
        """With `1 0 R` made references."""
        out: list = []
        for x in items:
            if x == "R" and isinstance(x, Operator) and len(out) > 1:
                out[-2:] = [Ref(out[-2:])]
            else:
                out.append(x)
        return out

    def dictionary(self) -> dict:
        items = []
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                break
            items.append(self.next())
        items = self.fold(items)
        return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, str)}

    def literal(self) -> bytes:
        out, depth = bytearray(), 1
        self.at += 1
        d, n = self.data, len(self.data)
        while self.at < n:
            c = d[self.at]
            self.at += 1
            if c == 0x5C and self.at < n:
                m = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                else:
                    e = chr(d[self.at])
                    self.at += 1
                    if e == "\r" and d[self.at : self.at + 1] == b"\n":
                        self.at += 1
                    elif e not in "\r\n":
                        out += _ESCAPES.get(e, e).encode("latin-1")
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return bytes(out)


class File:
    def __init__(self, data: bytes):
        self.data, self.warnings = data, []
        self.offsets = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.held: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"trailer\s*(?=<<)", data):
            self.trailer = self.trailer | self.parse(m.end())
        for n in list(self.offsets):
            o = self.object(n)
            kind = o.head.get("Type") if isinstance(o, Stream) else None
            if kind == "XRef":
                self.trailer = o.head | self.trailer
            elif kind == "ObjStm":
                self.unpack(o)

    def parse(self, at: int):
        try:
            return Lexer(self.data, at).next()
        except (EOFError, ValueError, RecursionError):
            return {}

    def unpack(self, s: Stream) -> None:
        data = self.bytes_of(s)
        lexer = Lexer(data)
        try:
            pairs = [(lexer.next(), lexer.next()) for _ in range(int(self.get(s.head.get("N", 0))))]
            first = int(self.get(s.head.get("First", 0)))
            for n, at in pairs:
                if n not in self.offsets:
                    self.held[n] = Lexer(data, first + at).next()
        except (EOFError, TypeError, ValueError):
            self.warnings.append(Warning_("malformed_content", "an object stream is broken", None))

    def object(self, n: int):
        if n in self.held:
            return self.held[n]
        if n not in self.offsets:
            return None
        self.held[n] = None
        lexer = Lexer(self.data, self.offsets[n])
        try:
            o = lexer.next()
            if isinstance(o, dict):
                lexer.skip()
                if self.data[lexer.at : lexer.at + 6] == b"stream":
                    at = lexer.at + 6
                    at += 2 if self.data[at : at + 2] == b"\r\n" else 1
                    size = self.get(o.get("Length"))
                    if not isinstance(size, int) or not re.match(rb"\s*endstream", self.data[at + size : at + size + 16]):
                        end = self.data.find(b"endstream", at)
                        size = (len(self.data) if end < 0 else end) - at
                    o = Stream(o, self.data[at : at + size])
        except (EOFError, ValueError, RecursionError):
            o = None
        self.held[n] = o
        return o

    def get(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.object(x[0])
        return None

    def dict_of(self, x) -> dict:
        x = self.get(x)
        return x.head if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    def list_of(self, x) -> list:
        x = self.get(x)
        return x if isinstance(x, list) else []

    def bytes_of(self, s) -> bytes:
        s = self.get(s)
        if not isinstance(s, Stream):
            return b""
        data = s.data
        filters = self.get(s.head.get("Filter"))
        params = self.get(s.head.get("DecodeParms"))
        for i, f in enumerate(filters if isinstance(filters, list) else [filters] if filters else []):
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    self.warnings.append(Warning_("partial_extraction", "a stream cannot be inflated", None))
                    return b""
                p = self.dict_of(params[i] if isinstance(params, list) and i < len(params) else params)
                data = _unpredict(data, int(self.get(p.get("Predictor", 1))), int(self.get(p.get("Columns", 1))))
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"):
                return data
            else:
                self.warnings.append(Warning_("unsupported_element", f"filter {f} is not read", None))
                return b""
        return data

    def pages(self) -> list[dict]:
        """Leaves of the page tree with what they inherit; without a tree, all page objects."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref, above: dict, depth: int) -> None:
            key = ref[0] if isinstance(ref, Ref) else None
            node = self.dict_of(ref)
            if key in seen or depth > 64 or not node:
                return
            if key is not None:
                seen.add(key)
            held = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.list_of(node["Kids"]):
                    walk(kid, held, depth + 1)
            else:
                out.append(held | node)

        walk(self.dict_of(self.trailer.get("Root")).get("Pages"), {}, 0)
        return out or [d for n in sorted(self.offsets) if (d := self.dict_of(self.object(n))).get("Type") == "Page"]


def _unpredict(data: bytes, predictor: int, columns: int) -> bytes:
    if predictor < 10:
        return data
    out, before = bytearray(), bytes(columns)
    for i in range(0, len(data), columns + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + columns])
        for k in range(len(row)):
            a, b, c = (row[k - 1] if k else 0), before[k], (before[k - 1] if k else 0)
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = {0: 0, 1: a, 2: b, 3: (a + b) // 2}.get(kind, 0)
            row[k] = (row[k] + near) & 255
        before = bytes(row).ljust(columns, b"\0")
        out += row
    return bytes(out)


class Font:
    """Codes of a string to text and widths."""

    def __init__(self, file: File, spec: dict):
        self.name = str(file.get(spec.get("BaseFont", "")) or "")
        self.wide = file.get(spec.get("Subtype")) == "Type0"
        self.map: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = PLAIN_WIDTH
        cmap = file.bytes_of(spec.get("ToUnicode"))
        if cmap:
            self._cmap(cmap)
        encoding = file.get(spec.get("Encoding"))
        differences = file.list_of(file.dict_of(encoding).get("Differences")) if isinstance(encoding, dict) else []
        at = 0
        for x in differences:
            if isinstance(x, int):
                at = x
            else:
                self.map.setdefault(at, _glyph(str(x)))
                at += 1
        if self.wide:
            below = file.dict_of((file.list_of(spec.get("DescendantFonts")) or [None])[0])
            self.default = file.get(below.get("DW", 1000))
            w, i = file.list_of(below.get("W")), 0
            while i + 1 < len(w):
                if isinstance(nxt := file.get(w[i + 1]), list):
                    self.widths.update({w[i] + k: file.get(v) for k, v in enumerate(nxt)})
                    i += 2
                elif i + 2 < len(w):
                    self.widths.update(dict.fromkeys(range(w[i], min(nxt, w[i] + 65535) + 1), file.get(w[i + 2])))
                    i += 3
                else:
                    break
        else:
            first = file.get(spec.get("FirstChar", 0)) or 0
            self.widths = {first + k: file.get(v) for k, v in enumerate(file.list_of(spec.get("Widths")))}

    def _cmap(self, data: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            lexer = Lexer(block)
            try:
                while True:
                    a, b = lexer.next(), lexer.next()
                    self.map[int.from_bytes(a, "big")] = text(b)
            except (EOFError, TypeError, AttributeError):
                pass
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            lexer = Lexer(block)
            try:
                while True:
                    a, b, c = lexer.next(), lexer.next(), lexer.next()
                    low, high = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535)
                    for k in range(low, high + 1):
                        if isinstance(c, list):
                            if k - low < len(c):
                                self.map[k] = text(c[k - low])
                        else:
                            self.map[k] = text(c[:-2] + ((int.from_bytes(c[-2:], "big") + k - low) & 0xFFFF).to_bytes(2, "big"))
            except (EOFError, TypeError, AttributeError):
                pass

    def read(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """Text, width in units of the size, and whether it is a one-byte space."""
        step = 2 if self.wide else 1
        for i in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[i : i + step], "big")
            width = self.widths.get(code, self.default)
            plain = "" if self.wide else bytes([code]).decode("cp1252", "replace").replace("�", "")
            yield self.map.get(code, plain), (width if isinstance(width, (int, float)) else self.default) / 1000.0, step == 1 and code == 32


#: Glyph names that are not a letter themselves.
_GLYPHS = {
    "space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "parenleft": "(",
    "parenright": ")", "quotesingle": "'", "quotedbl": '"', "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "bullet": "•", "endash": "–",
    "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "fi": "fi", "fl": "fl",
    "ellipsis": "…", "ampersand": "&", "percent": "%", "plus": "+", "equal": "=", "question": "?", "exclam": "!",
}


def _glyph(name: str) -> str:
    if len(name) == 1:
        return name
    m = re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name)
    return chr(int(m[1] or m[2], 16)) if m else _GLYPHS.get(name, "")


def _times(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def _at(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class Content:
    """Interprets a page's operators; gives characters, segments and images in page space."""

    def __init__(self, file: File):
        self.file = file
        self.chars: list[tuple] = []  # text, x, y, width, size, font, artifact
        self.segments: list[tuple] = []
        self.images: list[tuple] = []

    def run(self, data: bytes, resources: dict, base: tuple = (1, 0, 0, 1, 0, 0), depth: int = 0) -> None:
        file = self.file
        fonts = file.dict_of(resources.get("Font"))
        objects = file.dict_of(resources.get("XObject"))
        made: dict[str, Font] = {}
        state = {"m": base, "font": None, "size": 0.0, "lead": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0}
        saved, line, text = [], (1, 0, 0, 1, 0, 0), (1, 0, 0, 1, 0, 0)
        path: list[tuple] = []
        start = here = (0.0, 0.0)
        artifact, marked, operands = 0, [], []
        lexer = Lexer(data)

        def show(s: bytes) -> None:
            nonlocal text
            if state["font"] is None:
                return
            for ch, width, space in state["font"].read(s):
                m = _times(text, state["m"])
                size = state["size"] * (m[2] ** 2 + m[3] ** 2) ** 0.5
                x, y = _at(m, 0, state["rise"])
                advance = (width * state["size"] + state["char"] + state["word"] * space) * state["scale"]
                glyph = width * state["size"] * state["scale"] * (m[0] ** 2 + m[1] ** 2) ** 0.5
                if ch:
                    self.chars.append((ch, x, y, glyph, size, state["font"].name, artifact > 0))
                text = _times((1, 0, 0, 1, advance, 0), text)

        while True:
            try:
                x = lexer.next()
            except EOFError:
                return
            except (ValueError, RecursionError):
                continue
            if not isinstance(x, Operator):
                operands.append(x)
                continue
            op, v, operands = str(x), operands, []
            try:
                if op == "q":
                    saved.append(dict(state))
                elif op == "Q" and saved:
                    state = saved.pop()
                elif op == "cm":
                    state["m"] = _times(tuple(v[-6:]), state["m"])
                elif op == "BT":
                    line = text = (1, 0, 0, 1, 0, 0)
                elif op == "Tf":
                    key = str(v[-2])
                    if key not in made:
                        made[key] = Font(file, file.dict_of(fonts.get(key)))
                    state["font"], state["size"] = made[key], float(v[-1])
                elif op in ("Tc", "Tw", "TL", "Ts"):
                    state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[op]] = float(v[-1])
                elif op == "Tz":
                    state["scale"] = v[-1] / 100.0
                elif op in ("Td", "TD"):
                    if op == "TD":
                        state["lead"] = -v[-1]
                    line = text = _times((1, 0, 0, 1, v[-2], v[-1]), line)
                elif op == "Tm":
                    line = text = tuple(map(float, v[-6:]))
                elif op in ("T*", "'", '"'):
                    if op == '"':
                        state["word"], state["char"] = v[-3], v[-2]
                    line = text = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                    if op != "T*":
                        show(v[-1])
                elif op == "Tj":
                    show(v[-1])
                elif op == "TJ":
                    for part in v[-1]:
                        if isinstance(part, bytes):
                            show(part)
                        else:
                            text = _times((1, 0, 0, 1, -part / 1000.0 * state["size"] * state["scale"], 0), text)
                elif op == "m":
                    start = here = (v[-2], v[-1])
                elif op == "l":
                    path.append((*here, v[-2], v[-1]))
                    here = (v[-2], v[-1])
                elif op in ("c", "v", "y"):
                    here = (v[-2], v[-1])
                elif op == "h":
                    path.append((*here, *start))
                    here = start
                elif op == "re":
                    a, b, w, h = v[-4:]
                    path += [(a, b, a + w, b), (a + w, b, a + w, b + h), (a + w, b + h, a, b + h), (a, b + h, a, b)]
                elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                    if op in ("s", "b", "b*") and path:
                        path.append((*here, *start))
                    if op != "n":
                        for a, b, c, d in path:
                            self.segments.append((*_at(state["m"], a, b), *_at(state["m"], c, d), artifact > 0))
                    path = []
                elif op == "Do":
                    o = file.get(objects.get(str(v[-1])))
                    if isinstance(o, Stream) and o.head.get("Subtype") == "Form" and depth < 12:
                        inner = tuple(map(float, file.list_of(o.head.get("Matrix")) or (1, 0, 0, 1, 0, 0)))
                        self.run(file.bytes_of(o), file.dict_of(o.head.get("Resources")) or resources, _times(inner, state["m"]), depth + 1)
                    elif isinstance(o, Stream):
                        self.images.append((state["m"], o))
                elif op in ("BMC", "BDC"):
                    marked.append(str(v[0]) == "Artifact" if v else False)
                    artifact += marked[-1]
                elif op == "EMC" and marked:
                    artifact -= marked.pop()
                elif op == "BI":
                    end = re.compile(rb"\sEI(?=\s|$)").search(lexer.data, lexer.at)
                    lexer.at = end.end() if end else len(lexer.data)
            except (IndexError, TypeError, ValueError, ZeroDivisionError):
                continue


def _spans(chars: list[tuple]) -> Iterator[tuple]:
    """Characters to spans: a new one where font, size, baseline or a wide gap says so. A gap of a space's width is one."""
    held: list[tuple] = []
    parts: list[str] = []

    def done() -> tuple | None:
        text = "".join(parts)
        return (text.strip(), held[0][1], held[0][2], held[-1][1] + held[-1][3] - held[0][1], held[0][4], held[0][5]) if text.strip() else None

    for c in chars:
        if held:
            last = held[-1]
            gap, unit = c[1] - (last[1] + last[3]), max(last[4], 1e-6)
            same = c[5] == last[5] and abs(c[4] - last[4]) < 0.1 and abs(c[2] - held[0][2]) <= DRIFT * unit
            if not same or gap > 1.0 * unit or gap < -1.0 * unit:
                if s := done():
                    yield s
                held, parts = [], []
            elif gap > GAP * unit * 0.5 and not parts[-1].endswith(" ") and c[0] != " ":
                parts.append(" ")
        held.append(c)
        parts.append(c[0])
    if held and (s := done()):
        yield s


def decode(data: bytes, contents: bool = True) -> Decoded:
    """contents: whether the pages are read; else only what the file says of itself."""
    if not data.startswith(b"%PDF-"):
        raise DecodeError("no PDF header")
    file = File(data)
    if "Encrypt" in file.trailer:
        return Decoded("pdf", len(file.pages()), "physical_pages", None, True, [], file.warnings)
    root = file.dict_of(file.trailer.get("Root"))
    info = file.get(file.dict_of(file.trailer.get("Info")).get("Title"))
    lang = file.get(root.get("Lang"))
    lang = lang.decode("latin-1").strip() or None if isinstance(lang, bytes) else None
    pages, out = file.pages(), []
    if not pages:
        raise DecodeError("no pages")
    for number, page in enumerate(pages if contents else []):
        box = [float(file.get(x)) for x in (file.list_of(page.get("CropBox")) or file.list_of(page.get("MediaBox")) or [0, 0, 612, 792])]
        left, low, width, height = min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]) or 1.0, abs(box[3] - box[1]) or 1.0
        turn = int(file.get(page.get("Rotate", 0)) or 0) % 360

        def place(x: float, y: float, l=left, b=low, w=width, h=height, t=turn) -> tuple[float, float]:
            u, v = (x - l) / w, (y - b) / h
            return {90: (v, u), 180: (1 - u, v), 270: (1 - v, 1 - u)}.get(t, (u, 1 - v))

        def boxed(x0: float, y0: float, x1: float, y1: float, place=place) -> tuple[float, float, float, float]:
            (a, b), (c, d) = place(x0, y0), place(x1, y1)
            return min(a, c), min(b, d), abs(c - a), abs(d - b)

        content = Content(file)
        streams = file.get(page.get("Contents"))
        data_ = b"\n".join(file.bytes_of(s) for s in (streams if isinstance(streams, list) else [streams]) if s is not None)
        content.run(data_, file.dict_of(page.get("Resources")))
        links = []
        for a in file.list_of(page.get("Annots")):
            a = file.dict_of(a)
            target = file.get(file.dict_of(a.get("A")).get("URI"))
            rect = [float(file.get(x)) for x in file.list_of(a.get("Rect"))]
            if a.get("Subtype") == "Link" and isinstance(target, bytes) and len(rect) == 4:
                links.append((boxed(*rect), target.decode("latin-1")))
        skipped = sum(c[6] for c in content.chars)
        if skipped:
            file.warnings.append(Warning_("filtered_artifact", f"{skipped} characters of artifacts are left out", number))
        for text, x, y, w, size, font in _spans([c for c in content.chars if not c[6]]):
            bx = boxed(x, y - 0.2 * size, x + w, y + 0.8 * size)
            hints = [Hint("link", url=u) for u in _best_link(bx, links)]
            low_name = font.lower()
            out.append(
                Primitive(
                    "text", number, len(out), *bx, nfc(text), size, re.sub("^[A-Z]{6}\\+", "", font),
                    bool(re.search("bold|black|heavy", low_name)), bool(re.search("italic|oblique", low_name)),
                    "rtl" if lang and lang.split("-")[0].lower() in RTL_LANGUAGES else "ltr", lang,
                    origin="observed", space="physical_page", hints=hints,
                )
            )
        for x0, y0, x1, y1, hidden in content.segments:
            if not hidden:
                out.append(Primitive("line", number, len(out), *boxed(x0, y0, x1, y1), origin="observed", space="physical_page"))
        for m, o in content.images:
            (ax, ay), (bx_, by) = _at(m, 0, 0), _at(m, 1, 1)
            kind = {"DCTDecode": "jpeg", "JPXDecode": "jpeg2000"}.get(str(file.get(o.head.get("Filter"))), "raw")
            out.append(
                Primitive("image", number, len(out), *boxed(ax, ay, bx_, by), None, None, kind, data=file.bytes_of(o), origin="observed", space="physical_page")
            )
    if lang is None:
        texts = [p for p in out if p.kind == "text"]
        guessed = language_of_letters(lambda letters: sum(len(re.findall(letters, p.content)) for p in texts))
        for p in texts if guessed else []:
            p.lang, p.direction = guessed, "rtl" if guessed in RTL_LANGUAGES else "ltr"
    title = info.decode("utf-16" if info[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1", "replace").strip() if isinstance(info, bytes) else ""
    return Decoded("pdf", len(pages), "physical_pages", title or None, False, out, file.warnings)


def _best_link(box: tuple, links: list) -> list[str]:
    """Target of the link that covers most of the text, at least half of its width."""
    best, found = 0.0, []
    for (x, y, w, h), url in links:
        wide = min(box[0] + box[2], x + w) - max(box[0], x)
        high = min(box[1] + box[3], y + h) - max(box[1], y)
        if box[2] > 0 and wide >= 0.5 * box[2] and high > 0 and wide / box[2] > best:
            best, found = wide / box[2], [url]
    return found
