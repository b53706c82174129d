"""Settings of a consolidation, read leniently: what cannot be understood is left out, blank values take one away."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields
from typing import Any

PASS_MARK, SCALE = 9.5, 20.0


def number(value: Any) -> float | None:
    """A finite number, with a comma or a point; None for anything else."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        out = float(str(value).strip().replace(",", "."))
    except ValueError:
        return None
    return out if math.isfinite(out) else None


def whole(value: Any) -> int | None:
    """A whole number; halves go to the even one."""
    out = number(value)
    return None if out is None else round(out)


def _texts(value: Any) -> list[str]:
    return list(dict.fromkeys(str(x) for x in value or [] if str(x).strip()))


@dataclass
class Settings:
    """K4. Per-subject and per-student maps hold only what was set."""

    pass_mark: float = PASS_MARK
    scale: float = SCALE
    subject_pass_marks: dict[str, float] = field(default_factory=dict)
    subject_aliases: dict[str, str] = field(default_factory=dict)
    subject_curriculum: dict[str, dict] = field(default_factory=dict)
    removed_subjects: list[str] = field(default_factory=list)
    manual_subjects: list[str] = field(default_factory=list)
    removed_students: list[str] = field(default_factory=list)
    confirmed_sources: list[str] = field(default_factory=list)
    grade_overrides: dict[str, dict[str, float]] = field(default_factory=dict)
    merge_by_name: bool = True
    language: str = "pt"
    theme: str = "auto"

    @classmethod
    def of(cls, raw: dict | None) -> Settings:
        raw = raw or {}
        out = cls(pass_mark=number(raw.get("pass_mark")) if number(raw.get("pass_mark")) is not None else PASS_MARK, scale=number(raw.get("scale")) or SCALE)
        out.subject_pass_marks = {s: v for s, x in (raw.get("subject_pass_marks") or {}).items() if (v := number(x)) is not None}
        out.subject_aliases = {k: str(v) for k, v in (raw.get("subject_aliases") or {}).items() if str(v or "").strip()}
        for subject, meta in (raw.get("subject_curriculum") or {}).items():
            meta = meta if isinstance(meta, dict) else {}
            kept: dict[str, Any] = {k: v for k in ("year", "semester", "ects") if (v := whole(meta.get(k))) is not None}
            if str(meta.get("course") or "").strip():
                kept["course"] = str(meta["course"]).strip()
            if kept:
                out.subject_curriculum[subject] = kept
        for student, grades in (raw.get("grade_overrides") or {}).items():
            kept = {s: v for s, x in (grades or {}).items() if (v := number(x)) is not None}
            if kept:
                out.grade_overrides[student] = kept
        out.removed_subjects, out.confirmed_sources = (sorted(_texts(raw.get(k))) for k in ("removed_subjects", "confirmed_sources"))
        out.manual_subjects, out.removed_students = _texts(raw.get("manual_subjects")), _texts(raw.get("removed_students"))
        out.merge_by_name = bool(raw.get("merge_by_name", True))
        out.language = raw.get("language") if raw.get("language") in ("pt", "en") else "pt"
        out.theme = raw.get("theme") if raw.get("theme") in ("auto", "light", "dark") else "auto"
        return out

    def to_dict(self) -> dict:
        return asdict(self)

    def merged(self, change: dict) -> Settings:
        """K3: maps are merged key by key, a blank value deletes; everything else is replaced."""
        now = self.to_dict()
        for f in fields(self):
            if f.name not in change:
                continue
            new = change[f.name]
            if isinstance(now[f.name], dict) and isinstance(new, dict):
                for k, v in new.items():
                    old = now[f.name].get(k)
                    if isinstance(v, dict) and isinstance(old, dict):
                        v = {a: b for a, b in (old | v).items() if b not in (None, "")}
                    if v in (None, "", {}):
                        now[f.name].pop(k, None)
                    else:
                        now[f.name][k] = v
            else:
                now[f.name] = new
        return Settings.of(now)
