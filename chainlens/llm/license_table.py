"""Known licence texts and notices as a table of (licence id, text).

Whole texts lie in ``license_texts``, one file a licence id.  Notices are every
wording crossed with every name; a name without a version gives an id without
one.  Nothing here grows with the data.
"""

from __future__ import annotations

import re
from pathlib import Path

FOLDER = Path(__file__).parent / "license_texts"

# Titles that stand before a text which doesn't hold its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT", ""],
    "ISC": ["ISC License", "The ISC License", "ISC", ""],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "BSD License", "New BSD License",
                     "Modified BSD License", ""],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "BSD License", "Simplified BSD License", ""],
    "Zlib": ["zlib License", "The zlib License", "zlib", ""],
}

_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License as published by the Free Software Foundation, {which}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see
<https://www.gnu.org/licenses/>."""

# Names by licence id, without an article.
_GNU_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_GNU_VERSIONS = {"GPL": ["1", "2", "3"], "LGPL": ["2", "2.1", "3"], "AGPL": ["3"]}
_CC = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial",
       "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_VERSIONED = {
    "Apache": (["Apache License", "Apache Software License"], ["Apache"], ["1.1", "2.0"]),
    "MPL": (["Mozilla Public License"], ["MPL"], ["1.1", "2.0"]),
    "EPL": (["Eclipse Public License"], ["EPL"], ["1.0", "2.0"]),
    "BSL": (["Boost Software License"], ["BSL"], ["1.0"]),
    "Artistic": (["Artistic License"], ["Artistic"], ["1.0", "2.0"]),
}
_PLAIN = {
    "MIT": ["MIT License", "MIT", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "zlib"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "0BSD"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "BSD": ["BSD License", "BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause",
                     "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License",
                     "BSD-3-Clause", "BSD-3-Clause License"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 License", "Creative Commons Zero", "Creative Commons Zero v1.0 Universal",
                "Creative Commons CC0 1.0 Universal License"],
}
WORDINGS = ["Released under {}.", "Licensed under {}.", "Distributed under {}."]
WORDINGS += [f"This {x} is licensed under {{}}." for x in ("work", "software", "project", "program")]


def _versions(v: str) -> list[str]:
    """A whole version is also written without its zero."""
    forms = [v, v[:-2]] if v.endswith(".0") else [v] if "." in v else [v, v + ".0"]
    return [x for f in forms for x in (f" version {f}", f" v{f}", f" {f}")]


def names() -> list[tuple[str, str]]:
    out = [(i, n) for i, given in _PLAIN.items() for n in given]
    for i, (long, short, versions) in _VERSIONED.items():
        out += [(i, n) for n in long + short]
        for v in versions:
            out += [(f"{i}-{v}", n + f) for n in long + short for f in _versions(v)]
            out += [(f"{i}-{v}", f"{n}{f} License") for n in short for f in _versions(v)]
    for i, long in _GNU_NAMES.items():
        every = [f"GNU {long}", i, f"GNU {i}"]
        out += [(i, n) for n in every]
        for v in _GNU_VERSIONS[i]:
            key = f"{i}-{v if '.' in v else v + '.0'}"
            for n in every:
                out += [(key, n + f) for f in _versions(v)]
                out += [(f"{key}-or-later", f"{n}{f} {end}") for f in _versions(v)
                        for end in ("or later", "or any later version")]
            out.append((key, f"{i}v{v}"))
    for i, long in _CC.items():
        short = i.replace("CC-", "CC ")
        every = [short, f"Creative Commons {long}", f"Creative Commons {short[3:]}"]
        out += [(i, n + end) for n in every for end in ("", " License")]
        for v, kind in (("2.0", " Generic"), ("2.5", " Generic"), ("3.0", " Unported"), ("4.0", " International")):
            out += [(f"{i}-{v}", f"{n} {v}{end}") for n in every for end in ("", " License", kind, kind + " License")]
    return out


def notices() -> list[tuple[str, str]]:
    out = []
    for i, n in names():
        out.append((i, f"SPDX-License-Identifier: {n}"))
        articles = ["the ", "the terms of the "] if re.search("licen[sc]e", n.lower()) else ["", "the "]
        if n.startswith("Creative"):
            articles.append("a ")
        out += [(i, w.format(a + n)) for w in WORDINGS for a in articles]
    return list(dict.fromkeys(out))


def texts() -> list[tuple[str, str]]:
    out = []
    for path in sorted(FOLDER.glob("*.txt")):
        i, text = path.stem, path.read_text(encoding="utf-8")
        forms = [text]
        # The part behind the terms tells how to apply them; many copies leave it out.
        end = re.search(r"END OF TERMS AND CONDITIONS[^\n]*\n", text)
        if end:
            forms += [text[:end.end()], text[:end.start()]]
        out += [(i, f) for f in forms]
        if i == "BSD-3-Clause":
            two = re.sub(r"3\. Neither.*?permission\.\s+", "", text, flags=re.S)
            for key, t in ((i, text), ("BSD-2-Clause", two)):
                marked = [t, re.sub(r"(?m)^\d\. ", "* ", t)]
                out += [(key, f"{title}\n\n{m}") for title in TITLES[key] for m in marked]
    return out


def titled(given: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The given texts under each usual title of their licence."""
    out = []
    for i, text in given:
        if i in TITLES and "\n\n" in text:
            body = text.split("\n\n", 1)[1]
            out += [(i, f"{title}\n\n{body}") for title in TITLES[i]]
    return out


def headers() -> list[tuple[str, str]]:
    out = []
    for i, kind in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")):
        for v in _GNU_VERSIONS[i]:
            key = f"{i}-{v if '.' in v else v + '.0'}"
            for which, end in ((f"either version {v} of the License, or (at your option) any later version", "-or-later"),
                               (f"version {v} of the License", "")):
                out += [(key + end, _GNU.format(what=what, kind=kind, which=which))
                        for what in ("program", "library", "software", "file")]
    out.append(("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."))
    return out
