"""License scans by sentence-rule recognition.

A text is cut into sentences (at line blanks, sentence ends and comment borders), sentences are normalised (lower case,
comment marks and punctuation dropped, spaces squeezed) and each is mapped to the identifiers of known licence sentences.
The sequence of identifiers is then matched against ordered rules, the most specific first: a rule names a licence and the
identifiers that make it up, in order, with others between them only if they are marked as fill. Identifiers that a rule
has used are gone for the rules after it. What no rule takes, but is a licence sentence, is reported as "unknown".

Only sentences with a trigger word are normalised; each pattern can only fit where one of its triggers stands, so this drops
nothing. Most texts have none and cost a few substring searches.

Null and empty texts, and texts without licence sentences, have no finding. Equal licences that occur twice are reported
twice, with their spans (code points of the first sentence's start and the last one's end). Rows that repeat are scanned
alike; texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lean_batches, narrowed, read_table

#: Identifiers of licence sentences, and a pattern over the normalised sentence. The first that fits counts.
SENTENCES = [
    ("spdx", r"\bspdx-license-identifier (?P<id>[a-z0-9.+-]+(?: (?:or|and|with) (?:[a-z.+-]*[0-9-][a-z0-9.+-]*|[a-z.+]+(?=$| or | and | with )))*)"),
    ("mit-permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", r"the above copyright notice and this permission notice (shall|must) be included in all copies or substantial portions"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc-permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-disclaimer", r"the software is provided as is and the authors? disclaims? all warranties"),
    ("as-is", r"the software is provided as is without warranty of any kind"),
    ("bsd-intro", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", r"neither the name .* nor the names of its contributors may be used to endorse or promote"),
    ("bsd-disclaimer", r"this software is provided by .* as is and any express or implied warranties"),
    ("bsd-liability", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("apache2-grant", r"licensed under the apache license version 2\.0"),
    ("apache2-copy", r"you may obtain a copy of the license at http.*apache\.org licenses license-2\.0"),
    ("apache2-use", r"you may not use this file except in compliance with the license"),
    ("apache2-disclaimer", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache2-limits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("lgpl-3-later", r"terms of the gnu lesser general public license .*version 3.*any later version"),
    ("lgpl-21-later", r"terms of the gnu lesser general public license .*version 2\.1.*any later version"),
    ("lgpl-3", r"gnu lesser general public license.* version 3"),
    ("lgpl-21", r"gnu lesser general public license.* version 2\.1"),
    ("agpl-3", r"gnu affero general public license.* version 3"),
    ("gpl-3-later", r"gnu general public license.* version 3.*any later version"),
    ("gpl-2-later", r"gnu general public license.* version 2.*any later version"),
    ("gpl-3", r"gnu general public license.* version 3"),
    ("gpl-2", r"gnu general public license.* version 2"),
    ("gpl-any", r"gnu (lesser |affero )?general public license"),
    ("gpl-hope", r"is distributed in the hope that it will be useful but without any warranty"),
    ("mpl-2", r"subject to the terms of the mozilla public license v(ersion)? ?\.? ?2\.0"),
    ("epl-2", r"eclipse public license v(ersion)? ?\.? ?2\.0"),
    ("bsl-1", r"distributed under the boost software license version 1\.0"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("cc0-1", r"\bcc0\b( 1\.0)?"),
    ("cc-by-nc-nd-4", r"(cc by-nc-nd 4\.0|creative commons attribution-?noncommercial-?noderivatives 4\.0)"),
    ("cc-by-nc-sa-4", r"(cc by-nc-sa 4\.0|creative commons attribution-?noncommercial-?sharealike 4\.0)"),
    ("cc-by-nc-4", r"(cc by-nc 4\.0|creative commons attribution-?noncommercial 4\.0)"),
    ("cc-by-sa-4", r"(cc by-sa 4\.0|creative commons attribution-?sharealike 4\.0)"),
    ("cc-by-nd-4", r"(cc by-nd 4\.0|creative commons attribution-?noderivatives 4\.0)"),
    ("cc-by-4", r"(cc by 4\.0|creative commons attribution 4\.0)"),
    ("mit-name", r"\b(under|the) (the )?mit license\b"),
    ("bsd3-name", r"\b(3-clause bsd|bsd 3-clause|new bsd|modified bsd) license\b"),
    ("bsd2-name", r"\b(2-clause bsd|bsd 2-clause|simplified bsd|freebsd) license\b"),
    ("isc-name", r"\bisc license\b"),
    ("apache2-name", r"\bapache (software )?license (version )?2\.0|\bapache-2\.0\b"),
    ("public-domain", r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("reserved", r"\ball rights reserved\b"),
    ("holder", r"\bcopyright (c |©)?\d{4}"),
    ("some-license", r"\b(licensed|released|distributed|available) under\b|\bterms of the .* license\b|\bsee the license\b"),
]

#: Ordered rules. Identifiers of a rule must follow each other; holder and reserved may stand between them.
RULES = [
    ("BSD-4-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-disclaimer", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-disclaimer", "bsd-liability")),
    ("MIT", ("mit-name", "mit-permission", "mit-notice", "as-is", "mit-liability")),
    ("MIT", ("mit-permission", "mit-notice", "as-is", "mit-liability")),
    ("MIT-0", ("mit-permission", "as-is", "mit-liability")),
    ("ISC", ("isc-permission", "isc-disclaimer")),
    ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy", "apache2-disclaimer", "apache2-limits")),
    ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-3-later", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-21-later", "gpl-hope")),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-name",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3-later",)),
    ("LGPL-2.1-or-later", ("lgpl-21-later",)),
    ("AGPL-3.0-only", ("agpl-3",)),
    ("LGPL-3.0-only", ("lgpl-3",)),
    ("LGPL-2.1-only", ("lgpl-21",)),
    ("GPL-3.0-only", ("gpl-3",)),
    ("GPL-2.0-only", ("gpl-2",)),
    ("GPL", ("gpl-any",)),
    ("MPL-2.0", ("mpl-2",)),
    ("EPL-2.0", ("epl-2",)),
    ("BSL-1.0", ("bsl-1",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0-1",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("MIT", ("mit-name",)),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("ISC", ("isc-name",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("reserved",)),
]
FILL = ("holder", "reserved")
FOUND = "doc_id long, sentences array<struct<id:string,start:long,end:long>>, licences array<struct<licence:string,start:long,end:long>>"

#: What a sentence is called where nothing better is in it.
GENERIC = "some-license"

_PATTERNS = [(name, re.compile(p)) for name, p in SENTENCES]
#: A sentence ends at a blank line, or at . ! ? ; behind which a space or a line end stands (not inside 2.0 or a link).
_END = re.compile(r"\n[ \t]*[/*#;%-]*[ \t]*\n|[.!?;](?=\s)|\*/|-->|\Z")
_MARKS = re.compile(r"[^a-z0-9.+©-]+")
_DOTS = re.compile(r"(?<![0-9a-z])[.+-]+|[.+-]+(?![0-9a-z])")


def required_words(pattern: str) -> set[str]:
    """Words (or parts of one) one of which stands in each sentence that the pattern fits; words survive normalising whole."""

    def best(items) -> set[str]:
        sets, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is _parser.LITERAL and chr(arg) != " ":
                run += chr(arg)
                continue
            if run:
                sets.append({run})
                run = ""
            if op is _parser.SUBPATTERN:
                sets.append(best(arg[-1]))
            elif op is _parser.BRANCH:
                parts = [best(x) for x in arg[1]]
                sets.append(set().union(*parts) if all(parts) else set())
            elif op is _parser.MAX_REPEAT and arg[0]:
                sets.append(best(arg[2]))
        return max((x for x in sets if x), key=lambda x: min(map(len, x)), default=set())

    return best(_parser.parse(pattern))


def _triggers() -> tuple[str, ...]:
    words = set().union(*[required_words(p) for _, p in SENTENCES])
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


def normalised(sentence: str) -> str:
    """Lower case, comment marks and punctuation dropped but for dots and hyphens inside words, spaces squeezed."""
    return " ".join(_DOTS.sub(" ", _MARKS.sub(" ", sentence.lower())).split())


#: Lower-case words one of which each known licence sentence holds.
TRIGGERS = _triggers()


def known_sentences(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the licence sentences of text, in order. A line that is one by itself counts alone."""
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    exact = len(low) == len(text)  # else lower-casing changed lengths and the trigger test runs on each sentence
    out, start = [], 0
    for m in _END.finditer(text):
        end = m.end() if m.group() and m.group()[0] in ".!?;" else m.start()
        part = low[start:end] if exact else text[start:end].lower()
        if any(t in part for t in TRIGGERS):
            out += _recognised(text, start, end)
        start = m.end()
    return out


def _recognised(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """What the sentence as a whole (wrapped lines joined) holds; where its lines alone hold as much, by lines."""
    lines, at, words = [], start, 0
    for line in text[start:end].split("\n"):
        if line.strip():
            plain = normalised(line)
            lines.append((at, at + len(line), words, _identifiers(plain)))
            words += len(plain.split())
        at += len(line) + 1
    whole = _identifiers(normalised(text[start:end]))
    alone = [(n + w, name, a, b) for a, b, w, found in lines for n, name in found]
    if len(lines) > 1:
        whole = [x for x in whole if not x[1].startswith("spdx:")]  # an SPDX tag ends with its line
        names, have = {x[1] for x in whole}, {x[1] for x in alone}
        if alone and names <= have:
            return [x[1:] for x in alone]
        alone = [x for x in alone if x[1] in names or x[1].startswith("spdx:")]
        whole = [x for x in whole if x[1] not in have]
    else:
        alone = []
    lead = len(text[start:end]) - len(text[start:end].lstrip())
    return [x[1:] for x in sorted([*alone, *((n, name, start + lead, end) for n, name in whole)])]


def _identifiers(sentence: str) -> list[tuple[int, str]]:
    """(number of its first word, identifier) of all patterns that fit in order of place; of those that overlap the first listed."""
    taken, out = [], []
    for name, p in _PATTERNS:
        if name == GENERIC and any(n not in FILL for _, n in out):
            continue
        for m in p.finditer(sentence):
            if any(m.start() < b and a < m.end() for a, b in taken):
                continue
            taken.append(m.span())
            at = sentence.count(" ", 0, m.start())
            if name == "spdx":  # an expression; exceptions (with ...) are no licences
                out += [(at, f"spdx:{x}") for x in re.split(r" (?:or|and) ", re.sub(r" with \S+", "", m["id"]))]
            else:
                out.append((at, name))
                break
    return sorted(out, key=lambda x: x[0])


def matched_rules(sentences: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the ordered rules, in order of place."""
    free = [True] * len(sentences)
    out = []
    for n, (name, a, b) in enumerate(sentences):
        if name.startswith("spdx:"):
            free[n] = False
            out.append((name[5:], a, b))
    for licence, names in RULES:
        for first in range(len(sentences)):
            used, at = [], first
            for name in names:
                while at < len(sentences) and used and sentences[at][0] in FILL and sentences[at][0] != name:
                    at += 1
                if at < len(sentences) and free[at] and sentences[at][0] == name:
                    used.append(at)
                    at += 1
                else:
                    break
            if len(used) == len(names):
                for u in used:
                    free[u] = False
                out.append((licence, sentences[used[0]][1], sentences[used[-1]][2]))
    out += [("unknown", a, b) for n, (name, a, b) in enumerate(sentences) if free[n] and name not in FILL]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def licence_findings(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifier, start, end), licences (licence, start, end) for each row of docs (doc_id, text)."""
    sentence = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    licence = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            known, rules = [], []
            for text in batch.column(1).to_pylist():
                s = known_sentences(text or "")
                known.append([{"id": n, "start": a, "end": b} for n, a, b in s])
                rules.append([{"licence": n, "start": a, "end": b} for n, a, b in (matched_rules(s) if s else ())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, sentence), pa.array(rules, licence)], names=["doc_id", "sentences", "licences"])

    lean_batches(docs.sparkSession)
    return narrowed(docs, doc_id="doc_id", text="text").mapInArrow(run, FOUND)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_findings(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda s: s["licence"]))), ",").alias("licences"),
        F.array_join(F.transform("licences", lambda s: F.concat_ws(":", s["licence"], s["start"], s["end"])), ",").alias("spans"),
    )


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE: dict[str, str] = {}
