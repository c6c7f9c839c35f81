"""License scans: ordered signature rules behind keyword gates, with DataFrame functions only.

A text becomes one string of words. Rules are regular expressions over that string, gated by keywords of which each
match holds one. A rule names a label, a priority and a weight. Where one match lies within another of the same or a higher
priority, the inner one is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The phrases every scan reports, with their labels: fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    #: Words of which each match holds one at least
    keywords: tuple[str, ...]
    priority: int
    weight: float


#: Families: label, keyword, name pattern, versions. Each version adds a rule of a higher priority than the bare name.
FAMILIES = (
    ("apache", "apache", "apache(?: software)? licen[sc]e", ("1 0", "1 1", "2 0")),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e", ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", ("2", "2 1", "3", "3 0")),
    ("lgpl", "library general", "(?:gnu )?library general public licen[sc]e", ("2", "2 0")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ("1", "3", "3 0")),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[sc]e", ("1 0", "2 0")),
    ("cpl", "common public", "common public licen[sc]e", ("1 0",)),
    ("cddl", "common development", "common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("eupl", "european union", "european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("osl", "open software", "open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "artistic licen[sc]e", ("1 0", "2 0")),
    ("bsl", "boost", "boost software licen[sc]e", ("1 0",)),
    ("busl", "business source", "business source licen[sc]e", ("1 0", "1 1")),
    ("elastic", "elastic", "elastic licen[sc]e", ("1 0", "2 0")),
    ("sspl", "server side", "server side public licen[sc]e", ("1",)),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", ()),
    ("zpl", "zope", "zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("psf", "python software", "python software foundation licen[sc]e", ("2",)),
    ("php", "php", "php licen[sc]e", ("3 0", "3 01")),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("odbl", "open database", "open database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e", ("1 0",)),
    ("ecl", "educational", "educational community licen[sc]e", ("1 0", "2 0")),
    ("lppl", "latex", "latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3")),
    ("ipl", "ibm public", "ibm public licen[sc]e", ("1 0",)),
    ("npl", "netscape", "netscape public licen[sc]e", ("1 0", "1 1")),
    ("apsl", "apple public", "apple public source licen[sc]e", ("1 0", "1 1", "1 2", "2 0")),
    ("qpl", "q public", "q public licen[sc]e", ("1 0",)),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", ()),
    ("isc", "isc", "isc licen[sc]e", ()),
    ("mit", "mit", "mit licen[sc]e", ()),
    ("ncsa", "ncsa", "ncsa(?: open source)? licen[sc]e", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("beerware", "beer", "beer ?ware(?: licen[sc]e)?", ("42",)),
    ("upl", "universal permissive", "universal permissive licen[sc]e", ("1 0",)),
    ("cecill", "cecill", "cecill(?: [bc])?(?: free software)? licen[sc]e", ("1", "2 0", "2 1")),
    ("vim", "vim", "vim licen[sc]e", ()),
    ("ruby", "ruby", "ruby licen[sc]e", ()),
    ("openssl", "openssl", "openssl licen[sc]e", ()),
    ("x11", "x11", "x11 licen[sc]e", ()),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd(?: style)? licen[sc]e", ()),
    ("bsd-2", "bsd", "bsd 2 clause(?: licen[sc]e)?", ()),
    ("bsd-3", "bsd", "bsd 3 clause(?: licen[sc]e)?", ()),
    ("bsd-4", "bsd", "bsd 4 clause(?: licen[sc]e)?", ()),
)
#: Short identifiers as tags write them: label, keyword, pattern.
TAGS = (
    ("apache", "apache", "apache 2 0"), ("gpl", "gpl", "gpl(?: v)? ?[123](?: 0)?(?: only| or later)?"), ("gpl", "gplv", "gplv[123]"),
    ("lgpl", "lgpl", "lgpl(?: v)? ?[23](?: [01])?(?: only| or later)?"), ("agpl", "agpl", "agpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("mpl", "mpl", "mpl [12] [01]"), ("epl", "epl", "epl [12] 0"), ("eupl", "eupl", "eupl 1 [012]"), ("bsl", "bsl", "bsl 1 0"),
    ("ofl", "ofl", "ofl 1 [01]"), ("odbl", "odbl", "odbl(?: 1 0)?"), ("cc0", "cc0", "cc0(?: 1 0)?"), ("cddl", "cddl", "cddl 1 [01]"),
)
#: Creative Commons parts, as codes and as names: each with and without a version makes a rule.
CC_CODES = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_NAMES = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s",
    "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Grants, terms and notices without a license's name: label, keyword or keywords, pattern.
NOTICES = (
    ("public-domain", "public domain", "(?:released |dedicated |placed )?(?:in|into|to) the public domain"),
    ("permissive-grant", "hereby granted", "permission is hereby granted(?: free of charge)?"),
    ("permissive-grant", "hereby granted", "permission to use copy modify and or distribute this software .{0,80}is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms(?: with or without modification)? are permitted"),
    ("bsd", "endorse", "used to endorse or promote products"),
    ("gpl", "free software", "this (?:program|library) is free software you can redistribute it"),
    ("gpl", "redistribute", "redistribute it and or modify it under the terms of"),
    ("no-warranty", "warrant", "without (?:any )?warranty(?: of any kind)?"),
    ("no-warranty", "as is", "provided (?:by .{0,60})?as is"),
    ("no-warranty", "merchantability", "merchantability(?: and| or)? fitness for a particular purpose"),
    ("reserved", "rights reserved", "(?:all )?rights reserved"),
    ("reserved", "reproduced", "no part of this (?:publication|book|work|document) may be reproduced"),
    ("reserved", ("may not be", "must not be"), "(?:may|must) not be (?:copied|redistributed|reproduced)"),
    ("reserved", "proprietary", "proprietary and confidential"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright", "copyright", "copyright(?: c)? by"),
    ("reference", "licensed under", "(?:is |are )?licensed under(?: the)?"),
    ("reference", ("license", "licence"), "(?:under|subject to) the terms of (?:the|this)(?: [a-z0-9]+){0,4} licen[sc]e"),
    ("reference", "spdx", "spdx license identifier"),
    ("reference", ("license", "licence", "copying"), "see (?:the )?(?:file )?(?:licen[sc]e|copying)(?: file)? for(?: more)? details"),
)


def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, versions, names, codes, tags, notices. An earlier rule has a higher priority."""
    found: list[tuple[str, str, str | tuple[str, ...], float]] = [(label, phrase, phrase, 1.0) for phrase, label in BASE]
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            found.append((f"{label}-{v.replace(' ', '.')}", f"{name}(?: v| version)?(?: |)? ?{v}(?: only| or later)?", keyword, 1.0))
        found.append((label, name, keyword, 0.9))
    for code in CC_CODES:
        tag = "cc-" + code.replace(" ", "-")
        for v in CC_VERSIONS:
            found.append((f"{tag}-{v.replace(' ', '.')}", f"cc {code} {v}", "cc by", 1.0))
            found.append((f"{tag}-{v.replace(' ', '.')}", f"creative commons {CC_NAMES[code]}(?: licen[sc]e)?(?: international)? {v}", "creative commons", 1.0))
        found.append((tag, f"cc {code}", "cc by", 0.9))
        found.append((tag, f"creative commons {CC_NAMES[code]}(?: licen[sc]e)?", "creative commons", 0.9))
    found += [(label, pattern, keyword, 0.8) for label, keyword, pattern in TAGS]
    found += [(label, pattern, keyword, 0.5) for label, keyword, pattern in NOTICES]
    return tuple(
        Rule(label, pattern, (keyword,) if isinstance(keyword, str) else keyword, len(found) - k, weight) for k, (label, pattern, keyword, weight) in enumerate(found))


def word_string(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, a blank around each."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, NOT_WORD, " ")), F.lit(" "))


def blanks(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gate(listed: tuple[Rule, ...]) -> str:
    """One expression that any match of any rule must fulfil: a keyword at the start of a word, by first letter."""
    by_letter: dict[str, set[str]] = {}
    for keyword in (k for r in listed for k in r.keywords):
        by_letter.setdefault(keyword[0], set()).add(keyword[1:])
    return " (?:" + "|".join(f"{a}(?:{'|'.join(sorted(rest))})" for a, rest in sorted(by_letter.items())) + ")"


def detections(listed: tuple[Rule, ...]) -> str:
    """SQL for the matches of all rules with a keyword in the column `_words`: label, priority, weight, word span.

    What lies between a rule's matches and the matches themselves alternate, so positions are sums of their blanks.
    """
    table = ", ".join(
        f"named_struct('label', {_quoted(r.label)}, 'pattern', {_quoted(f'(?<= )(?:{r.pattern})(?= )')}, 'keywords', array({', '.join(_quoted(' ' + k) for k in r.keywords)}), "
        f"'priority', {r.priority}, 'weight', {r.weight}D)" for r in listed)
    kind = "array<struct<label:string,priority:int,weight:double,s:int,e:int>>"
    return f"""flatten(transform(filter(array({table}), r -> exists(r.keywords, k -> contains(_words, k))), r -> aggregate(
        zip_with(split(_words, r.pattern, -1), regexp_extract_all(_words, r.pattern, 0), (p, h) -> named_struct('p', p, 'h', h)),
        named_struct('at', -1, 'found', cast(array() as {kind})),
        (acc, x) -> named_struct(
            'at', acc.at + {blanks('x.p')} + if(x.h is null, 0, {blanks('x.h')}),
            'found', if(x.h is null, acc.found, concat(acc.found, array(named_struct(
                'label', r.label, 'priority', r.priority, 'weight', r.weight,
                's', acc.at + {blanks('x.p')}, 'e', acc.at + {blanks('x.p')} + {blanks('x.h')} + 1))))),
        acc -> acc.found)))"""


#: A match within another one of a higher priority doesn't count.
KEPT = "filter(_found, d -> not exists(_found, x -> x.priority > d.priority and x.s <= d.s and x.e >= d.e))"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per document: places of the base phrases, labels after suppression, a score.

    doc_id, n_words, n_base, first_word, last_word (of the places where a base phrase starts, else null), base_labels,
    labels (those and the kept detections'), score (the highest weight kept, 1 for a base phrase, else 0), found (the
    kept detections with their spans in words, the end outside). Null texts count as empty; null ids and repeated rows
    stay; only the two named columns are read. No shuffle; a text without a keyword meets no rule.
    """
    listed = rules() if listed is None else listed
    rows = docs.select(F.col(id_col).alias("doc_id"), word_string(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    phrases = "|".join(phrase for phrase, _ in BASE)
    has_base = " or ".join(f"contains(_words, ' {phrase} ')" for phrase, _ in BASE)
    rows = rows.withColumns({
        "n_words": F.expr(f"cast(if(length(_words) = 2, 0, {blanks('_words')} - 1) as bigint)"),
        "_cut": F.expr(f"if({has_base}, split(_words, ' (?=(?:{phrases}) )', -1), null)"),
        "_found": F.expr(f"if(_words rlike {_quoted(gate(listed))}, {detections(listed)}, null)"),
    })
    base = ", ".join(f"if(contains(_words, ' {phrase} '), '{label}', null)" for phrase, label in BASE)
    rows = rows.withColumns({"_kept": F.expr(KEPT), "_base": F.expr(f"array_sort(array_distinct(filter(array({base}), x -> x is not null)))")})
    return rows.select(
        "doc_id", "n_words",
        F.expr("cast(coalesce(size(_cut) - 1, 0) as bigint)").alias("n_base"),
        F.expr(f"if(_cut is null, null, cast(if(_cut[0] = '', 0, {blanks('_cut[0]')}) as bigint))").alias("first_word"),
        F.expr(f"if(_cut is null, null, n_words - cast({blanks('element_at(_cut, -1)')} as bigint))").alias("last_word"),
        F.expr("array_join(_base, ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(_base, coalesce(transform(_kept, d -> d.label), array())))), ',')").alias("labels"),
        F.expr("greatest(if(size(_base) > 0, 1D, 0D), coalesce(array_max(transform(_kept, d -> d.weight)), 0D))").alias("score"),
        F.expr("coalesce(_kept, array())").alias("found"),
    )
