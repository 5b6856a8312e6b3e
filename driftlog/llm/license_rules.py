"""Signature rules for licence texts, built from families and their versions.

A rule has a keyword that must stand in the lower-cased text before its regex
is tried, a priority (1 tag, 2 full name or grant, 3 mention) and a label. Every
match of the regex holds the keyword, a space in it being any white space.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str
    priority: int
    label: str
    pattern: str


#: Identifier stem, name as a regex, keyword of the name, versions.
FAMILIES = [
    ("GPL", r"gnu\s+general\s+public\s+licen[cs]e", "general public", ("1.0", "2.0", "3.0")),
    ("LGPL", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e", "general public", ("2.0", "2.1", "3.0")),
    ("AGPL", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e", "affero", ("1.0", "3.0")),
    ("GFDL", r"gnu\s+free\s+documentation\s+licen[cs]e", "free documentation", ("1.1", "1.2", "1.3")),
    ("Apache", r"apache\s+(?:software\s+)?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("MPL", r"mozilla\s+public\s+licen[cs]e", "mozilla", ("1.0", "1.1", "2.0")),
    ("EPL", r"eclipse\s+public\s+licen[cs]e", "eclipse", ("1.0", "2.0")),
    ("CDDL", r"common\s+development\s+and\s+distribution\s+licen[cs]e", "common development", ("1.0", "1.1")),
    ("EUPL", r"european\s+union\s+public\s+licen[cs]e", "european union", ("1.0", "1.1", "1.2")),
    ("AFL", r"academic\s+free\s+licen[cs]e", "academic free", ("1.1", "2.0", "2.1", "3.0")),
    ("OSL", r"open\s+software\s+licen[cs]e", "open software", ("1.0", "2.0", "2.1", "3.0")),
    ("Artistic", r"artistic\s+licen[cs]e", "artistic", ("1.0", "2.0")),
    ("BSL", r"boost\s+software\s+licen[cs]e", "boost", ("1.0",)),
    ("OFL", r"(?:sil\s+)?open\s+font\s+licen[cs]e", "open font", ("1.0", "1.1")),
    ("ODbL", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", "database", ("1.0",)),
    ("CPL", r"common\s+public\s+licen[cs]e", "common public", ("1.0",)),
    ("Python", r"python\s+(?:software\s+foundation\s+)?licen[cs]e", "python", ("2.0",)),
    ("PHP", r"php\s+licen[cs]e", "php", ("3.0", "3.01")),
    ("LPPL", r"latex\s+project\s+public\s+licen[cs]e", "latex", ("1.0", "1.1", "1.2", "1.3")),
    ("CECILL", r"cecill\s+(?:free\s+software\s+)?licen[cs]e", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("Zope", r"zope\s+public\s+licen[cs]e", "zope", ("1.1", "2.0", "2.1")),
]
#: Licences without versions: identifier, name or grant as a regex, keyword.
SINGLE = [
    ("MIT", r"mit\s+licen[cs]e", "mit"),
    ("MIT", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge", "hereby granted"),
    ("ISC", r"isc\s+licen[cs]e", "isc"),
    ("ISC", r"permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software", "permission to use"),
    ("BSD-2-Clause", r"(?:2|two)[-\s]clause\s+bsd(?:\s+licen[cs]e)?|simplified\s+bsd", "bsd"),
    ("BSD-3-Clause", r"(?:3|three)[-\s]clause\s+bsd(?:\s+licen[cs]e)?|(?:new|modified|revised)\s+bsd", "bsd"),
    ("BSD", r"bsd\s+licen[cs]e|bsd[-\s]style\s+licen[cs]e", "bsd"),
    ("BSD", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", "redistribution"),
    ("Zlib", r"zlib(?:/libpng)?\s+licen[cs]e", "zlib"),
    ("Unlicense", r"this\s+is\s+free\s+and\s+unencumbered\s+software|the\s+unlicense", "un"),
    ("WTFPL", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e", "do what"),
    ("CC0-1.0", r"cc0\s+1\.0\s+universal|cc[\s-]?zero", "cc"),
    ("CC0-1.0", r"creative\s+commons\s+zero", "creative commons"),
    ("PD", r"(?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain|public\s+domain\s+(?:work|dedication|mark)", "public domain"),
    ("Proprietary", r"proprietary\s+and\s+confidential|confidential\s+and\s+proprietary", "proprietary"),
    ("Proprietary", r"unauthori[sz]ed\s+(?:copying|reproduction|distribution|use)", "unauthori"),
    ("Proprietary", r"no\s+part\s+of\s+this\s+(?:publication|work|document|book)\s+may\s+be\s+reproduced", "reproduced"),
    ("NCSA", r"university\s+of\s+illinois[/\s]+ncsa\s+open\s+source\s+licen[cs]e", "ncsa"),
    ("PostgreSQL", r"postgresql\s+licen[cs]e", "postgresql"),
    ("Ruby", r"ruby\s+licen[cs]e|same\s+terms\s+as\s+ruby", "ruby"),
    ("Perl", r"same\s+terms\s+as\s+perl(?:\s+itself)?", "same terms"),
]
#: The terms of Creative Commons licences, as in their names and in words.
CC_TERMS = {
    "BY": r"attribution",
    "BY-SA": r"attribution[-\s]+share[-\s]?alike",
    "BY-NC": r"attribution[-\s]+non[-\s]?commercial",
    "BY-ND": r"attribution[-\s]+no[-\s]?deriv(?:ative)?s?(?:\s+works)?",
    "BY-NC-SA": r"attribution[-\s]+non[-\s]?commercial[-\s]+share[-\s]?alike",
    "BY-NC-ND": r"attribution[-\s]+non[-\s]?commercial[-\s]+no[-\s]?deriv(?:ative)?s?(?:\s+works)?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

B, Z = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}]|\.\p{N})"  # no letter or digit beside it


def _version(v: str) -> str:
    whole, _, part = v.partition(".")
    number = rf"{whole}(?:\.0)?" if part == "0" else re.escape(v)
    return rf",?[-\s(]*(?:version|ver\.?|v\.?)?\s*{number}"


def rules() -> list[Rule]:
    out: list[Rule] = []
    tag = r"spdx-license-identifier:\s*"

    def add(keyword: str, priority: int, label: str, pattern: str) -> None:
        out.append(Rule(keyword, priority, label.lower(), B + "(?:" + pattern + ")" + Z))

    for stem, name, keyword, versions in FAMILIES:
        gnu = stem in ("GPL", "LGPL", "AGPL", "GFDL")
        for v in versions:
            own = f"{stem}-{v}"
            for end, words in [("", ""), ("-only", r"\s+only"), ("-or-later", r"\s*,?\s*or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?")][: 3 if gnu else 1]:
                add("spdx", 1, own + end, tag + re.escape((own + end).lower()) + (r"\+?" if not end else ""))
                add(keyword, 2, own + end, name + _version(v) + words)
            add(stem.lower(), 3, own, rf"{stem.lower()}[-\s]?v?{re.escape(v)}" + (rf"|{stem.lower()}[-\s]?v?{v[0]}" if v.endswith(".0") else ""))
        add(keyword, 3, stem, name)
    for ident, pattern, keyword in SINGLE:
        add(keyword, 2, ident, pattern)
    for ident in dict.fromkeys(i for i, _, _ in SINGLE if i not in ("PD", "Proprietary", "Perl", "BSD")):
        add("spdx", 1, ident, tag + re.escape(ident.lower()))
    for terms, words in CC_TERMS.items():
        short = r"cc[-\s_]?" + terms.lower().replace("-", r"[-\s_]")
        for v in CC_VERSIONS:
            add("spdx", 1, f"CC-{terms}-{v}", tag + re.escape(f"cc-{terms.lower()}-{v}"))
            for k in ("cc by", "cc-by", "cc_by", "ccby"):
                add(k, 2, f"CC-{terms}-{v}", short + rf"[-\s_]*v?{re.escape(v)}")
            add("creative commons", 2, f"CC-{terms}-{v}", r"creative\s+commons\s+" + words + rf"(?:\s+\w+)?,?\s*(?:licen[cs]e\s*)?,?\s*(?:version\s*|v)?{re.escape(v)}")
        for k in ("cc by", "cc-by", "cc_by", "ccby"):
            add(k, 3, f"CC-{terms}", short)
        add("creative commons", 3, f"CC-{terms}", r"creative\s+commons\s+" + words)
    add("creative commons", 3, "CC", r"creative\s+commons")
    add("rights reserved", 3, "reserved", r"(?:all|some)\s+rights\s+reserved")
    add("copyright", 3, "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:1[89]|20)\p{N}{2}")
    add("licen", 3, "other-licence", r"(?:licen[cs]ed|released|distributed)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+|an?\s+)?[\p{L}\p{N}.-]+(?:\s+[\p{L}\p{N}.-]+){0,3}\s+licen[cs]e")
    return out
