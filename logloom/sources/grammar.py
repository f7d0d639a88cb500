"""Log formats as anchored regular expressions, one Column per field.

A field is null where its optional part is absent, and every field is null
where the line does not match (the line itself stays).  Adjacent words are
separated by ``\\s+`` so that no pattern can split a word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern of each format, and its fields as groups to join with a blank.
FORMATS: dict[str, tuple[str, dict[str, tuple[int, ...]]]] = {
    "auth": (
        r"^([A-Z][a-z]{2})\s+([0-9]+)\s+([0-9]+:[0-9]+:[0-9]+)\s+([A-Za-z0-9_.\-]+)\s+([A-Za-z/\-_.]+)\s*(?:\[\s*([0-9]+)\s*\])?\s*:\s*(.*)",
        {"timestamp": (1, 2, 3), "hostname": (4,), "service": (5,), "pid": (6,), "message": (7,)},
    ),
    "kippo": (
        r"^([0-9]+-[0-9]+-[0-9]+)\s+([0-9]+:[0-9]+:[0-9]+\+0000)\s*\[\s*([A-Za-z0-9\-. ()]+)(?:\s*,\s*([0-9]+)\s*,\s*([0-9.]+))?\s*\]\s*(.*)",
        {"timestamp": (1, 2), "service": (3,), "port": (4,), "ip_address": (5,), "message": (6,)},
    ),
    "syslog": (
        r"^([A-Z][a-z]{2})\s+([0-9]+)\s+([0-9]+:[0-9]+:[0-9]+)\s+([A-Za-z0-9_.\-]+)\s+([A-Za-z/\-_.]+)\s*(?:\(\s*([A-Za-z_]+)\s*\))?\s*(?:\[\s*([0-9]+)\s*\])?\s*:?\s*(.*)",
        {"timestamp": (1, 2, 3), "hostname": (4,), "service": (5,), "word": (6,), "pid": (7,), "message": (8,)},
    ),
    "bluegene": (
        r"^([A-Za-z\-_]+)\s+([0-9]+)\s+([0-9]+\.[0-9]+\.[0-9]+)\s+([A-Za-z0-9\-:_]+)\s+([0-9]+-[0-9]+-[0-9]+-[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\s+([A-Za-z0-9\-:_]+)\s+([A-Za-z]+)\s+([A-Za-z]+)\s+([A-Za-z]+)\s*(.*)",
        {"sock": (1,), "number": (2,), "date": (3,), "core1": (4,), "timestamp": (5,), "core2": (6,), "source": (7,), "service": (8,), "info_type": (9,), "message": (10,)},
    ),
    "raslog": (
        r"^([0-9]+)\s+([A-Za-z0-9_]+)\s+([A-Za-z]+)\s+([A-Za-z0-9_]+)\s+([A-Za-z0-9_]+)\s+([A-Za-z]+)\s+([0-9]+-[0-9]+-[0-9]+-[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\s+([0-9\-]+)\s+([0-9\-]+)\s+([0-9\-]+)\s+([A-Za-z0-9\-_]+)\s+([A-Za-z0-9\-]+)\s+([A-Za-z0-9]+)\s+([A-Za-z0-9']+)\s*(.*)",
        {
            "rec_id": (1,), "message_id": (2,), "component": (3,), "subcomponent": (4,), "error_code": (5,), "severity": (6,), "timestamp": (7,),
            "flags": (8,), "processor": (9,), "node": (10,), "block": (11,), "location": (12,), "serial": (13,), "ecid": (14,), "message": (15,),
        },
    ),
    "vpnlog": (
        r"^([A-Z][a-z]{2})\s+([A-Z][a-z]{2})\s+([0-9]+)\s+([0-9]+:[0-9]+:[0-9]+)\s+([0-9]+)\s*(?:([A-Za-z0-9._/]+)\s*:\s*([0-9]+))?\s*(.*)",
        {"timestamp": (1, 2, 3, 4, 5), "source_address": (6,), "source_port": (7,), "message": (8,)},
    ),
    "snort_secrepo": (r"^([0-9/\-:.]+)\s+([A-Za-z\[*\]]+)\s+([A-Za-z0-9\[:\]]+)\s*(.*)", {"timestamp": (1,), "host": (2,), "someid": (3,), "message": (4,)}),
    "snort_sotm34": (
        r"^([A-Z][a-z]{2})\s+([0-9]+)\s+([0-9]+:[0-9]+:[0-9]+)\s+([A-Za-z]+)\s+([A-Za-z:]+)\s+([0-9\[:\]]+)\s*(.*)",
        {"timestamp": (1, 2, 3), "host": (4,), "pid": (5,), "someid": (6,), "message": (7,)},
    ),
    "httpd": (
        r"^([\[A-Za-z]+)\s+([A-Za-z]+)\s+([0-9]+)\s+([0-9]+:[0-9]+:[0-9]+)\s+([0-9\]]+)\s+([\[A-Za-z\]]+)\s*(.*)",
        {"timestamp": (1, 2, 3, 4, 5), "message_type": (6,), "message": (7,)},
    ),
}
FORMATS["casper"] = FORMATS["syslog"]


def only_group(pattern: str, wanted: int) -> str:
    """The pattern with one capturing group left, so that any engine can extract it as group 1."""
    count, out, i, inside = 0, [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = True if c == "[" and not inside else False if c == "]" and inside else inside
        if c == "(" and not inside and pattern[i + 1] != "?":
            count += 1
            out.append("(" if count == wanted else "(?:")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def fields(log_type: str, raw: Column) -> dict[str, Column]:
    """The Columns of a format, by field."""
    pattern, parts = FORMATS[log_type]
    found = raw.rlike(pattern)

    def one(group: int) -> Column:
        text = F.regexp_extract(raw, only_group(pattern, group), 1)
        return F.when(found & (text != ""), text)

    return {name: F.concat_ws(" ", *(one(g) for g in groups)) if len(groups) > 1 else one(groups[0]) for name, groups in parts.items()}


def parse(lines: DataFrame, log_type: str, raw: str = "raw", line_id: str = "line_id") -> DataFrame:
    """Grammar parse of ``lines``: the line id and all fields of the format."""
    if log_type not in FORMATS:
        raise ValueError(f"unknown log type {log_type!r}; known: {', '.join(sorted(FORMATS))}")
    return lines.select(line_id, *(c.alias(n) for n, c in fields(log_type, F.col(raw)).items()))


def field_names(log_type: str) -> list[str]:
    return list(FORMATS[log_type][1])


assert all(re.compile(p).groups == max(max(g) for g in f.values()) for p, f in FORMATS.values())
