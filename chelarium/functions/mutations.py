"""Point mutations in any common notation, read into R100K or K77del."""

from __future__ import annotations

import re

# Three-letter residue codes.
THREE_LETTER = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
    "Sec": "U", "Pyl": "O", "Asx": "B", "Glx": "Z", "Xaa": "X",
}
# Words and signs for a residue that is taken away.
DELETED = ("", "-", "–", "−", "del", "deletion", "deleted", "none", "null", "Δ", "∆", "*")

_ONE = {k.lower(): v for k, v in THREE_LETTER.items()}
_RESIDUE = "|".join(THREE_LETTER) + "|[A-Z]"
_MUTATION = re.compile(
    rf"(?<![A-Za-z0-9])(?:p\.\s*)?\(?(?:(?P<old>{_RESIDUE})\s*-?(?P<pos>\d{{1,6}})\s*(?:→|⟶|->|=>|>)?\s*(?P<new>del(?:eted|etion)?|Δ|∆|{_RESIDUE})|[Δ∆]\s*(?P<dold>{_RESIDUE})\s*(?P<dpos>\d{{1,6}}))(?![A-Za-z0-9])",
    re.IGNORECASE,
)


def one_letter(code: object) -> str | None:
    """One-letter code of a residue in one- or three-letter code, None if it is neither."""
    s = str(code).strip() if code is not None else ""
    if len(s) == 1 and s.isascii() and s.isalpha():
        return s.upper()
    return _ONE.get(s.lower())


def mutation_from_parts(old: object, position: object, new: object) -> str | None:
    """The mutation of an object with its parts; a missing new residue is a deletion."""
    a = one_letter(old)
    try:
        p = int(float(str(position)))
    except (ValueError, OverflowError):
        return None
    gone = new is None or str(new).strip().lower() in DELETED
    b = "del" if gone else one_letter(new)
    return f"{a}{p}{b}" if a and b else None


def canonical_mutations(text: str | None) -> list[str]:
    """All mutations named in a text, in order; a word or sign for none names none."""
    if not text:
        return []
    out = []
    for m in _MUTATION.finditer(text):
        if m["dold"]:
            out.append(f"{one_letter(m['dold'])}{int(m['dpos'])}del")
        else:
            gone = m["new"].lower().startswith("del") or m["new"] in "Δ∆"
            out.append(f"{one_letter(m['old'])}{int(m['pos'])}{'del' if gone else one_letter(m['new'])}")
    return out
