"""The small YAML files of a store: contacts, manifest, marker, summary.

A reader and a writer for their shapes (mappings and lists of mappings, scalars
and lists of scalars); both run on the driver, as the files are small. Contacts
become a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _scalar(text: str):
    t = text.strip()
    if t in ("", "null", "~"):
        return None
    if t in ("[]", "{}"):
        return [] if t == "[]" else {}
    if t[0] == '"' and t[-1] == '"':
        return re.sub(r'\\(["\\n])', lambda m: "\n" if m.group(1) == "n" else m.group(1), t[1:-1])
    if t[0] == "'" and t[-1] == "'":
        return t[1:-1].replace("''", "'")
    if re.fullmatch(r"-?\d+", t):
        return int(t)
    return {"true": True, "false": False}.get(t, t)


def load(text: str):
    """The value of a YAML text of the known shapes."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]

    def block(at: int, indent: int):
        if at >= len(lines) or lines[at][0] < indent:
            return None, at
        indent = lines[at][0]
        if lines[at][1].startswith("-"):
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                if re.match(r"[^\"'\s][^:]*:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                else:
                    value, at = _scalar(rest), at + 1
                out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            key, _, rest = lines[at][1].partition(":")
            key = str(_scalar(key))
            if rest.strip():
                out[key], at = _scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or (lines[at + 1][0] == indent and lines[at + 1][1].startswith("-"))):
                out[key], at = block(at + 1, lines[at + 1][0])
            else:
                out[key], at = None, at + 1
        return out, at

    return block(0, 0)[0] if lines else None


def dump(value, indent: int = 0) -> str:
    """A value of the known shapes as YAML."""
    pad = " " * indent

    def scalar(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, dict)):
            return "[]" if isinstance(v, list) else "{}"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:\n{dump(v, indent + 2)}" if isinstance(v, (dict, list)) and v else f"{pad}{k}: {scalar(v)}\n" for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}- {dump(v, indent + 2).lstrip()}" if isinstance(v, (dict, list)) and v else f"{pad}- {scalar(v)}\n" for v in value)
    return f"{pad}{scalar(value)}\n"


def upgrade_contacts(data: dict) -> dict:
    """The form with records of the older form, whose entries are ``phone: name`` texts."""
    out = dict(data or {})
    entries, kept = out.get("unprocessed") or [], {}
    for e in entries:
        if isinstance(e, str):
            phone, _, name = e.partition(":")
            kept.setdefault(phone.strip(), []).append(name.strip())
        else:
            for phone, names in ([(e.get("phone_number"), e.get("contact_names") or [])] if "phone_number" in e else list(e.items())):
                kept.setdefault(str(phone), []).extend([names] if isinstance(names, str) else names)
    out["unprocessed"] = [{"phone_number": p, "contact_names": n} for p, n in kept.items()]
    return out


def contacts_tables(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(contacts: contact_id, name, numbers; unprocessed: entry_id, phone_number, contact_names); an empty text gives empty tables."""
    data = upgrade_contacts(load(text) or {})
    texts = lambda values: [str(v) for v in values or []]
    c = [(i, x.get("name"), texts(x.get("numbers"))) for i, x in enumerate(data.get("contacts") or [], 1)]
    u = [(i, str(x["phone_number"]), texts(x["contact_names"])) for i, x in enumerate(data["unprocessed"], 1)]
    return spark.createDataFrame(c, "contact_id bigint, name string, numbers array<string>"), spark.createDataFrame(u, "entry_id bigint, phone_number string, contact_names array<string>")
