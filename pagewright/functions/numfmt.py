"""Spreadsheet number formats: a value and a format code to the text that a spreadsheet shows."""

from __future__ import annotations

import dataclasses
import functools
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format codes of the built-in ids.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?",
    13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0",
    48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|_(?P<pad>.)|\*(?P<fill>.)|\[(?P<bracket>[^\]]*)\]'
    r"|(?P<ampm>AM/PM|A/P)|(?P<exp>[Ee][+-])|(?P<frac>\.0+(?=[^0#?]|$))|(?P<date>[yYmMdDhHsS]+)|(?P<digit>[0#?])|(?P<other>.)",
    re.S,
)
_CONDITION = re.compile(r"(<=|>=|<>|<|>|=)\s*(-?[0-9.]+)$")
_COLORS = re.compile(r"(black|blue|cyan|green|magenta|red|white|yellow|color ?[0-9]+)$", re.I)


@dataclasses.dataclass(frozen=True)
class Section:
    """One of the parts between semicolons: its tokens, the condition if it names one, and what it formats."""

    tokens: tuple[tuple[str, str], ...]
    kind: str
    condition: tuple[str, float] | None


def _split(code: str) -> list[str]:
    out, quoted, i, held = [], False, 0, ""
    while i < len(code):
        ch = code[i]
        if ch == "\\" and not quoted:
            held += code[i : i + 2]
            i += 2
            continue
        if ch == '"':
            quoted = not quoted
        if ch == ";" and not quoted:
            out.append(held)
            held = ""
        else:
            held += ch
        i += 1
    return [*out, held][:4]


def _section(text: str) -> Section:
    tokens, condition, elapsed = [], None, False
    general = re.search(r"general", re.sub(r'"[^"]*"|\\.', "", text), re.I)
    if general:
        text = re.sub("general", "\x00", text, flags=re.I)
    for m in _TOKEN.finditer(text):
        name, value = m.lastgroup, m.group(m.lastgroup)
        if name == "bracket":
            found = _CONDITION.match(value)
            if found:
                condition = (found[1], float(found[2]))
            elif re.fullmatch(r"h+|m+|s+", value, re.I):
                tokens.append(("elapsed", value.lower()))
                elapsed = True
            elif value.startswith("$"):
                tokens.append(("literal", value[1:].split("-")[0]))
            elif not _COLORS.match(value):
                tokens.append(("literal", ""))
        elif name in ("quoted", "escaped"):
            tokens.append(("literal", value))
        elif name == "pad":
            tokens.append(("literal", " "))
        elif name == "fill":
            continue
        elif name == "other" and value == "\x00":
            tokens.append(("general", ""))
        else:
            tokens.append((name, value))
    names = {n for n, _ in tokens}
    others = {v for n, v in tokens if n == "other"}
    if elapsed:
        kind = "elapsed"
    elif "date" in names or "ampm" in names:
        kind = "date"
    elif "general" in names:
        kind = "general"
    elif "digit" in names or "frac" in names:
        kind = "number"
        tokens = [x for n, v in tokens for x in ([("other", "."), *[("digit", "0")] * (len(v) - 1)] if n == "frac" else [(n, v)])]
    elif "@" in others:
        kind = "text"
    else:
        kind = "literal"
    return Section(tuple(tokens), kind, condition)


@functools.lru_cache(maxsize=4096)
def parse(code: str) -> tuple[Section, ...]:
    return tuple(_section(x) for x in _split(code))


_TESTS = {
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
}


def _choose(sections: tuple[Section, ...], value: float) -> tuple[Section, bool]:
    """The section for a value, and whether the sign is still to be written."""
    numeric = sections[:3]
    if any(s.condition for s in numeric):
        for s in numeric:
            if s.condition and _TESTS[s.condition[0]](value, s.condition[1]):
                return s, value < 0
        rest = [s for s in numeric if not s.condition]
        return (rest[-1] if rest else numeric[-1]), value < 0
    if len(numeric) == 1 or value > 0 or value == 0 and len(numeric) < 3:
        return numeric[0], value < 0
    if value < 0:
        return numeric[1], False
    return numeric[2], False


def half_up(value: float, digits: int) -> float:
    """Rounded half away from zero on the scaled value."""
    scale = 10.0**digits
    scaled = value * scale
    return math.copysign(math.floor(abs(scaled) + 0.5), value) / scale if math.isfinite(scaled) else value


def general(value: float) -> str:
    if not math.isfinite(value):
        return "#NUM!"
    if value == 0:
        return "0"
    power = math.floor(math.log10(abs(value)))
    if not -4 <= power < 11:
        mantissa = half_up(abs(value) / 10.0**power, 5)
        if mantissa >= 10:
            mantissa, power = mantissa / 10, power + 1
        text = f"{mantissa:.5f}".rstrip("0").rstrip(".")
        return f"{'-' if value < 0 else ''}{text}E{'+' if power >= 0 else '-'}{abs(power):02d}"
    if value == int(value):
        return str(int(value))
    text = f"{value:.{max(10 - power, 0)}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _group(digits: str) -> str:
    return f"{int(digits):,}" if digits else digits


def _fill(places: list[str], digits: str) -> str:
    """Digits from the right into the places 0, # and ?; all that are left over stand before the first place."""
    out, rest = [], digits
    for p in reversed(places):
        if rest:
            out.append(rest[-1])
            rest = rest[:-1]
        else:
            out.append({"0": "0", "?": " ", "#": ""}[p])
    return rest + "".join(reversed(out))


def _number(s: Section, value: float) -> str:
    tokens = list(s.tokens)
    value = abs(value)
    value *= 100.0 ** sum(1 for n, v in tokens if n == "other" and v == "%")
    at = [i for i, (n, _) in enumerate(tokens) if n == "digit"]
    slash = next((i for i, t in enumerate(tokens) if t == ("other", "/")), None)
    if slash is not None and any(i < slash for i in at):
        return _fraction(tokens, slash, value)
    exp = next((i for i, (n, _) in enumerate(tokens) if n == "exp"), None)
    if exp is not None:
        return _scientific(tokens, exp, value)
    point = next((i for i, t in enumerate(tokens) if t == ("other", ".")), None)
    commas = [i for i, t in enumerate(tokens) if t == ("other", ",")]
    last = max([i for i in at if point is None or i < point], default=-1)
    grouped = any(at and at[0] < i < last for i in commas)
    edge = at[-1] if at else -1
    for i in commas:
        if i > last and (i < (point if point is not None else len(tokens)) or i > edge):
            value /= 1000.0
    decimals = [i for i in at if point is not None and i > point]
    whole, _, part = f"{half_up(value, len(decimals)):.{len(decimals)}f}".partition(".")
    whole = whole.lstrip("0")
    places = [i for i in at if i not in decimals]
    filled = _fill([tokens[i][1] for i in places], whole)
    if grouped:
        body = filled.strip()
        filled = " " * (len(filled) - len(filled.lstrip())) + (f"{int(body):,}" if body and len(body) == len(str(int(body))) else _commas(body))
    optional = len(part.rstrip("0"))
    for k, i in enumerate(decimals):
        if k >= optional and tokens[i][1] != "0" and all(tokens[j][1] != "0" for j in decimals[k:]):
            part = part[:k] + "".join(" " if tokens[j][1] == "?" else "" for j in decimals[k:])
            break
    inner = [t for j, t in enumerate(tokens) if places and places[0] < j < places[-1]]
    spread = any(v and n in ("literal", "other") and v != "," for n, v in inner)
    out, done = [], False
    taken = len(filled)
    for i, (n, v) in enumerate(tokens):
        if n == "digit" and i in decimals:
            out.append(part[:1])
            part = part[1:]
        elif n == "digit":
            if spread and not grouped:
                left = sum(1 for j in places if j > i)
                cut = max(len(filled) - left, 0)
                start = len(filled) - taken
                out.append(filled[start:cut])
                taken -= max(cut - start, 0)
            elif not done:
                out.append(filled)
                done = True
        elif n == "other" and v == ",":
            continue
        elif n == "other" and v == "@":
            continue
        else:
            out.append(v)
    return "".join(out)


def _commas(text: str) -> str:
    """Grouping of a number with leading zeros."""
    head = len(text) % 3
    parts = [text[:head]] * bool(head) + [text[i : i + 3] for i in range(head, len(text), 3)]
    return ",".join(parts)


def _scientific(tokens: list, exp: int, value: float) -> str:
    point = next((i for i, t in enumerate(tokens[:exp]) if t == ("other", ".")), None)
    at = [i for i, (n, _) in enumerate(tokens) if n == "digit"]
    whole = [i for i in at if i < exp and (point is None or i < point)]
    decimals = [i for i in at if point is not None and point < i < exp]
    power_places = [tokens[i][1] for i in at if i > exp]
    step = max(len(whole), 1)
    power = math.floor(math.log10(value)) if value else 0
    power = power - power % step if step > 1 else power
    mantissa = half_up(value / 10.0**power, len(decimals)) if value else 0.0
    if mantissa >= 10.0**step:
        mantissa, power = mantissa / 10.0**step, power + step
    first, _, part = f"{mantissa:.{len(decimals)}f}".partition(".")
    sign = tokens[exp][1][1]
    power_text = _fill(power_places, str(abs(power)).lstrip("0") or ("" if "0" in power_places else "0"))
    shown = "E" + ("-" if power < 0 else "+" if sign == "+" else "") + power_text
    out, said, powered = [], False, False
    for i, (n, v) in enumerate(tokens):
        if i in whole:
            if not said:
                out.append(_fill([tokens[j][1] for j in whole], first.lstrip("0")) if len(whole) > 1 else first)
                said = True
        elif i in decimals:
            out.append(part[decimals.index(i)])
        elif n == "exp":
            out.append(shown)
            powered = True
        elif n == "digit" and powered:
            continue
        else:
            out.append(v)
    return "".join(out)


def _fraction(tokens: list, slash: int, value: float) -> str:
    before = [i for i, (n, _) in enumerate(tokens[:slash]) if n == "digit"]
    after = [i for i, (n, _) in enumerate(tokens) if n == "digit" and i > slash]
    fixed = "".join(v for n, v in tokens[slash + 1 :] if n in ("other", "digit") and v.isdigit())
    gap = next((i for i in range(before[-1], before[0], -1) if i not in before), None)
    whole_places = [i for i in before if gap is not None and i < gap]
    top_places = [i for i in before if i not in whole_places]
    if fixed and fixed.strip("0"):
        bottom = int(fixed)
        top = int(half_up(value * bottom, 0))
    else:
        most = 10 ** max(len(after), 1) - 1
        best = Fraction(value).limit_denominator(most)
        top, bottom = best.numerator, best.denominator
    whole = 0
    if whole_places:
        whole, top = divmod(top, bottom)
    tail = f"{bottom}"
    width = len(after)
    if whole_places and top == 0:
        blank = " " * (1 + len(top_places) + 1 + (len(fixed) if fixed.strip("0") else width))
        return (_fill([tokens[i][1] for i in whole_places], str(whole) if whole else "") or "0") + (blank if any(tokens[i][1] == "?" for i in top_places) else "")
    text = _fill([tokens[i][1] for i in top_places], str(top)) + "/" + (tail if fixed.strip("0") else tail.ljust(width if all(tokens[i][1] == "?" for i in after) else 0))
    if whole_places:
        head = _fill([tokens[i][1] for i in whole_places], str(whole) if whole else "")
        return f"{head} {text}" if head else text
    return text


def _calendar(serial: int, date_1904: bool) -> tuple[int, int, int, int]:
    """Year, month, day and weekday (0: Sunday) of a day number; day 60 of the 1900 system is its false February 29."""
    if not date_1904 and serial == 60:
        return 1900, 2, 29, 3
    if not date_1904 and serial == 0:
        return 1900, 1, 0, 6
    # Days from 1970-01-01, then the civil calendar by eras of 400 years.
    days = serial - 24107 if date_1904 else serial - 25569 + (serial < 60)
    weekday = (days + 4) % 7 if date_1904 or serial > 60 else (days + 3) % 7
    z = days + 719468
    era, of_era = divmod(z, 146097)
    year = (of_era - of_era // 1460 + of_era // 36524 - of_era // 146096) // 365
    of_year = of_era - (365 * year + year // 4 - year // 100)
    m = (5 * of_year + 2) // 153
    day = of_year - (153 * m + 2) // 5 + 1
    month = m + 3 if m < 10 else m - 9
    return year + era * 400 + (month <= 2), month, day, weekday


def _date(s: Section, value: float, date_1904: bool) -> str | None:
    if value < 0 or value >= 2958466 or not math.isfinite(value):
        return None
    tokens = list(s.tokens)
    places = max([len(v) - 1 for n, v in tokens if n == "frac"], default=0)
    ticks = int(half_up(value * 86400 * 10**places, 0))
    whole, ticks = divmod(ticks, 86400 * 10**places)
    seconds, sub = divmod(ticks, 10**places)
    year, month, day, weekday = _calendar(whole, date_1904)
    hour, minute, second = seconds // 3600, seconds // 60 % 60, seconds % 60
    twelve = any(n == "ampm" for n, _ in tokens)
    shown = (hour % 12 or 12) if twelve else hour
    dates = [i for i, (n, _) in enumerate(tokens) if n == "date"]
    out = []
    for i, (n, v) in enumerate(tokens):
        low = v.lower()
        if n == "ampm":
            out.append(v.split("/")[hour >= 12])
        elif n == "frac":
            out.append("." + str(sub).zfill(places)[: len(v) - 1])
        elif n != "date":
            out.append("" if n == "elapsed" else v)
        else:
            for run in re.finditer(r"y+|m+|d+|h+|s+", low):
                k, w = run[0][0], len(run[0])
                if k == "m":
                    at = dates.index(i)
                    before = tokens[dates[at - 1]][1].lower()[-1] if at and run.start() == 0 else low[: run.start()][-1:]
                    after = low[run.end() : run.end() + 1] or (tokens[dates[at + 1]][1].lower()[0] if at + 1 < len(dates) else "")
                    if w <= 2 and (before == "h" or after == "s"):
                        out.append(str(minute).zfill(w))
                    else:
                        out.append([str(month), f"{month:02d}", MONTHS[month - 1][:3], MONTHS[month - 1], MONTHS[month - 1][0]][min(w, 5) - 1])
                elif k == "y":
                    out.append(f"{year % 100:02d}" if w <= 2 else f"{year:04d}")
                elif k == "d":
                    out.append([str(day), f"{day:02d}", DAYS[weekday][:3], DAYS[weekday]][min(w, 4) - 1])
                else:
                    out.append(str({"h": shown, "s": second}[k]).zfill(min(w, 2)))
    return "".join(out)


def _elapsed(s: Section, value: float) -> str:
    places = max([len(v) - 1 for n, v in s.tokens if n == "frac"], default=0)
    ticks = int(half_up(abs(value) * 86400 * 10**places, 0))
    seconds, sub = divmod(ticks, 10**places)
    first = next(v[0] for n, v in s.tokens if n == "elapsed")
    out = ["-"] if value < 0 else []
    for n, v in s.tokens:
        k, w = v[:1].lower(), len(v)
        if n == "elapsed":
            total = {"h": seconds // 3600, "m": seconds // 60, "s": seconds}[k]
            out.append(str(total).zfill(w))
        elif n == "date" and k in "hms":
            part = {"h": seconds // 3600, "m": seconds // 60 % 60 if first == "h" else seconds // 60, "s": seconds % 60}[k]
            out.append(str(part).zfill(min(w, 2)))
        elif n == "frac":
            out.append("." + str(sub).zfill(places))
        else:
            out.append(v)
    return "".join(out)


def format_value(value: float, code: str, date_1904: bool = False) -> tuple[str, str | None]:
    """The text, and a warning if the value cannot be shown in this format and General stands in."""
    if not math.isfinite(value):
        return "#NUM!", None
    sections = parse(code or "General")
    s, sign = _choose(sections, value)
    minus = "-" if sign else ""
    if s.kind == "general":
        body = general(abs(value))
        return minus + "".join(body if n == "general" else v for n, v in s.tokens), None
    if s.kind == "date":
        text = _date(s, value, date_1904)
        return (text, None) if text is not None else (general(value), "a number outside the calendar")
    if s.kind == "elapsed":
        return _elapsed(s, value), None
    if s.kind == "number":
        text = _number(s, value)
        return (minus + text if re.search("[1-9]", text) else text), None
    if s.kind == "text":
        return "".join(general(value) if v == "@" else v for _, v in s.tokens), None
    return (minus + "".join(v for _, v in s.tokens)) if s.tokens else "", None


def format_text(text: str, code: str) -> str:
    """A text value by the fourth section, or the only one if it has @."""
    sections = parse(code or "General")
    s = sections[3] if len(sections) > 3 else sections[0]
    return "".join(text if v == "@" else v for _, v in s.tokens) if s.kind == "text" else text


def format_column(value: Column, code: Column, date_1904: bool = False) -> Column:
    """format_value() of two columns; null values give null. Codes are parsed once a worker."""

    @F.pandas_udf("string")
    def shown(values: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(v) else format_value(float(v), c, date_1904)[0] for v, c in zip(values, codes)], dtype=object
        )

    return shown(value.cast("double"), code)


def fixed(value: Column, digits: int, grouped: bool = False) -> Column:
    """0.00 and #,##0.00 without Python: rounded half away from zero on the scaled value."""
    scale = float(10**digits)
    rounded = F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale
    text = F.format_string(f"%{',' if grouped else ''}.{digits}f", F.abs(rounded))
    return F.when(rounded < 0, F.concat(F.lit("-"), text)).otherwise(text)
