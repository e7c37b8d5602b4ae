"""Known licences: notices, full texts as files, and the paragraphs that only one of those texts has."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

#: (licence, text): notices. Fixed values.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]
#: Headings that files put before a licence's text. Fixed values.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "License: MIT"],
    "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"],
}
#: Where terms end and an appendix on their use begins; its place for a name, which files fill with a copyright line. Fixed values.
END, PLACE = "END OF TERMS AND CONDITIONS", "Copyright [yyyy] [name of copyright owner]"
#: Words of a paragraph that is told apart by itself.
LEAST_WORDS = 20
TEXTS = Path(__file__).parent / "licence_texts"


def variants(name: str, text: str) -> list[str]:
    """The ways in which files have a text: with or without a heading, its appendix, or numbers before its conditions."""
    found = [text, text.replace(PLACE, "")]
    if END in text:
        found.append(text[: text.index(END) + len(END)])
    if name.startswith("BSD"):
        found.append(re.sub(r"(?m)^\s*\d\.\s", "", text))
    found += [f"{title}\n\n{x}" for x in found for title in TITLES.get(name, [])]
    return list(dict.fromkeys(found))


@cache
def texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


@cache
def known() -> tuple[tuple[str, str], ...]:
    """(licence, text) of notices and of full texts in all their variants."""
    return (*NOTICES, *((name, x) for name, text in texts().items() for x in variants(name, text)))


@cache
def sections() -> tuple[tuple[str, str], ...]:
    """(licence, paragraph) of longer paragraphs that one text alone has."""
    plain = lambda p: " ".join(re.findall(r"[a-z0-9]+", p.lower()))
    owners: dict[str, set[str]] = {}
    shown: dict[str, str] = {}
    for name, text in texts().items():
        for p in re.split(r"\n\s*\n", text):
            if len(plain(p).split()) >= LEAST_WORDS:
                owners.setdefault(plain(p), set()).add(name)
                shown[plain(p)] = p
    return tuple((next(iter(o)), shown[k]) for k, o in owners.items() if len(o) == 1)
