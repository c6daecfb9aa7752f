"""License scan: ordered signature rules over the words of a text.

A text is read as its lower-cased words joined by one space, so rules need not care for
marks and line ends.  One keyword test gates a text; each rule's own keyword gates the
rule.  Every place a rule matches is a detection, an interval of words.  A detection
inside another one of higher priority (or of the same priority and longer, or earlier
in the rules) is suppressed.  Base phrases are found beside the rules and always stay.

Only built-in functions, one narrow pass.  Defined results: a null text has no words;
without any detection the labels are empty and the score is 0.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_texts

#: Phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing; the commonest characters are asked for first.
_ANY_WORD = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]++"

# label | priority | keyword | patterns over the joined words, each a rule of its own, split by " ;; "
_TEXT = r"""
mit | 90 | mit | (released|licensed|distributed|available|published) under (the )?(terms of the )?mit licen[cs]e ;; (the )?mit licen[cs]e mit ;; licen[cs]e mit ;; mit licensed ;; x11 mit licen[cs]e
mit | 95 | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 94 | permission notice | the above copyright notice and this permission notice shall be included
mit | 60 | mit | mit licen[cs]e
mit | 60 | expat | expat licen[cs]e
mit-0 | 92 | attribution | mit no attribution ;; spdx license identifier mit 0
x11 | 88 | x11 | x11 licen[cs]e
x11 | 88 | consortium | x consortium licen[cs]e
apache-2.0 | 95 | apache | licensed under the apache licen[cs]e version 2( 0)? ;; apache licen[cs]e version 2( 0)? ;; apache licen[cs]e 2( 0)? ;; apache 2( 0)? licen[cs]e ;; asl 2 0 apache ;; spdx license identifier apache 2 0
apache-2.0 | 97 | apache | apache org licenses license 2 0 ;; you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache
apache-1.1 | 95 | apache | apache (software )?licen[cs]e version 1 1 ;; apache 1 1
apache-1.0 | 94 | apache | apache (software )?licen[cs]e version 1 0
apache | 60 | apache | apache (software )?licen[cs]e ;; licen[cs]e apache
gpl-3.0 | 95 | general public | gnu general public licen[cs]e version 3 ;; gnu general public licen[cs]e v3 ;; general public licen[cs]e as published by the free software foundation either version 3 ;; general public licen[cs]e 3
gpl-2.0 | 95 | general public | gnu general public licen[cs]e version 2 ;; gnu general public licen[cs]e v2 ;; general public licen[cs]e as published by the free software foundation either version 2 ;; general public licen[cs]e 2
gpl-1.0 | 94 | general public | gnu general public licen[cs]e version 1 ;; general public licen[cs]e as published by the free software foundation either version 1
gpl-3.0 | 90 | gpl | gpl ?v?3( 0)?( only| or later)? ;; gplv3 ;; licensed under (the )?gpl version 3
gpl-2.0 | 90 | gpl | gpl ?v?2( 0)?( only| or later)? ;; gplv2 ;; licensed under (the )?gpl version 2
gpl | 70 | general public | (gnu )?general public licen[cs]e
gpl | 60 | gpl | (under|the) (the )?(gnu )?gpl ;; gpl licen[cs]e ;; gnu gpl
gpl | 80 | redistribute | this program is free software you can redistribute it and or modify it
gpl | 55 | software foundation | free software foundation inc
lgpl-3.0 | 97 | lesser | lesser general public licen[cs]e version 3 ;; lesser general public licen[cs]e v3 ;; lesser general public licen[cs]e as published by the free software foundation either version 3
lgpl-2.1 | 97 | lesser | lesser general public licen[cs]e version 2 1 ;; lesser general public licen[cs]e v2 1 ;; lesser general public licen[cs]e as published by the free software foundation either version 2 1
lgpl-2.0 | 96 | library general | library general public licen[cs]e version 2 ;; library general public licen[cs]e v2
lgpl | 85 | general public | (lesser|library) general public licen[cs]e
lgpl-3.0 | 92 | lgpl | lgpl ?v?3( 0)? ;; lgplv3
lgpl-2.1 | 92 | lgpl | lgpl ?v?2 1 ;; lgplv2 1
lgpl | 65 | lgpl | gnu lgpl ;; (the|under) lgpl ;; lgpl licen[cs]e
agpl-3.0 | 97 | affero | affero general public licen[cs]e version 3 ;; affero general public licen[cs]e v3
agpl-1.0 | 96 | affero | affero general public licen[cs]e version 1
agpl | 85 | affero | affero general public licen[cs]e ;; affero gpl
agpl-3.0 | 92 | agpl | agpl ?v?3( 0)? ;; agplv3
agpl | 65 | agpl | gnu agpl ;; (the|under) agpl
bsd-3-clause | 95 | bsd | (3|three) clause bsd ;; bsd (3|three) clause ;; new bsd licen[cs]e ;; modified bsd licen[cs]e ;; revised bsd licen[cs]e
bsd-2-clause | 95 | bsd | (2|two) clause bsd ;; bsd (2|two) clause ;; simplified bsd licen[cs]e ;; freebsd licen[cs]e
bsd-4-clause | 95 | bsd | (4|four) clause bsd ;; bsd (4|four) clause ;; original bsd licen[cs]e
0bsd | 96 | bsd | zero clause bsd ;; bsd zero clause
0bsd | 96 | 0bsd | 0bsd
bsd | 60 | bsd | bsd licen[cs]e ;; bsd style licen[cs]e ;; bsd licensed ;; under (the )?bsd ;; licen[cs]e bsd
bsd-3-clause | 96 | neither the name | neither the name of .{0,80}nor the names of its contributors may be used
bsd | 85 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 96 | advertising | all advertising materials mentioning features or use of this software must display
mpl-2.0 | 95 | mozilla | mozilla public licen[cs]e( v| version)? 2( 0)? ;; mpl 2 0 mozilla ;; mozilla org mpl 2 0
mpl-1.1 | 95 | mozilla | mozilla public licen[cs]e( v| version)? 1 1
mpl-1.0 | 94 | mozilla | mozilla public licen[cs]e( v| version)? 1 0
mpl | 60 | mozilla | mozilla public licen[cs]e
mpl-2.0 | 90 | mpl | mpl ?v?2 0
mpl-1.1 | 90 | mpl | mpl ?v?1 1
epl-2.0 | 95 | eclipse | eclipse public licen[cs]e( v| version)? 2( 0)?
epl-1.0 | 95 | eclipse | eclipse public licen[cs]e( v| version)? 1( 0)?
epl | 60 | eclipse | eclipse public licen[cs]e
edl-1.0 | 90 | eclipse | eclipse distribution licen[cs]e( v| version)? 1( 0)? ;; eclipse distribution licen[cs]e
cddl-1.0 | 95 | distribution license | common development and distribution license( cddl)?( v| version)? 1 0
cddl-1.1 | 95 | distribution license | common development and distribution license( cddl)?( v| version)? 1 1
cddl | 60 | cddl | cddl ;; cddl licen[cs]e
cpl-1.0 | 90 | common public | common public licen[cs]e( v| version)? 1 0 ;; common public licen[cs]e
ipl-1.0 | 90 | ibm | ibm public licen[cs]e( v| version)? 1 0 ;; ibm public licen[cs]e
cc-by-4.0 | 90 | cc by | cc by 4( 0)? ;; cc by 4 0 international
cc-by-3.0 | 90 | cc by | cc by 3( 0)?
cc-by-2.5 | 90 | cc by | cc by 2 5
cc-by-2.0 | 90 | cc by | cc by 2 0
cc-by | 60 | cc by | licensed under (a |the )?cc by ;; cc by licen[cs]e
cc-by-sa-4.0 | 93 | cc by sa | cc by sa 4( 0)?
cc-by-sa-3.0 | 93 | cc by sa | cc by sa 3( 0)?
cc-by-sa | 70 | cc by sa | cc by sa
cc-by-nc-4.0 | 93 | cc by nc | cc by nc 4( 0)?
cc-by-nc-3.0 | 93 | cc by nc | cc by nc 3( 0)?
cc-by-nc | 70 | cc by nc | cc by nc
cc-by-nd-4.0 | 93 | cc by nd | cc by nd 4( 0)?
cc-by-nd-3.0 | 93 | cc by nd | cc by nd 3( 0)?
cc-by-nd | 70 | cc by nd | cc by nd
cc-by-nc-sa-4.0 | 95 | cc by nc sa | cc by nc sa 4( 0)?
cc-by-nc-sa-3.0 | 95 | cc by nc sa | cc by nc sa 3( 0)?
cc-by-nc-sa | 80 | cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | 95 | cc by nc nd | cc by nc nd 4( 0)?
cc-by-nc-nd-3.0 | 95 | cc by nc nd | cc by nc nd 3( 0)?
cc-by-nc-nd | 80 | cc by nc nd | cc by nc nd
cc-by-4.0 | 92 | attribution | creative commons attribution 4 0 ;; attribution 4 0 international ;; creativecommons org licenses by 4 0
cc-by-3.0 | 92 | attribution | creative commons attribution 3 0 ;; attribution 3 0 unported
cc-by | 65 | attribution | creative commons attribution( licen[cs]e)?
cc-by-sa-4.0 | 94 | sharealike | attribution sharealike 4 0
cc-by-sa-3.0 | 94 | sharealike | attribution sharealike 3 0
cc-by-sa | 72 | sharealike | attribution sharealike
cc-by-sa | 72 | share alike | attribution share alike
cc-by-nc-4.0 | 94 | noncommercial | attribution noncommercial 4 0
cc-by-nc | 72 | noncommercial | attribution noncommercial
cc-by-nc | 72 | non commercial | attribution non commercial
cc-by-nd | 72 | noderivatives | attribution noderivatives ;; attribution noderivs
cc-by-nc-sa | 82 | noncommercial | attribution noncommercial sharealike
cc-by-nc-nd | 82 | noncommercial | attribution noncommercial noder(ivative)?i?vs?
cc-by-4.0 | 93 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-4.0 | 93 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | 93 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 93 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 95 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 95 | creativecommons | creativecommons org licenses by nc nd 4 0
cc0-1.0 | 95 | cc0 | cc0 1 0( universal)? ;; cc0 public domain ;; cc0 licen[cs]e ;; (under|the) cc0
cc0-1.0 | 93 | creativecommons | creativecommons org publicdomain zero 1 0
cc | 40 | creative commons | creative commons licen[cs]e ;; licensed under (a )?creative commons
public-domain | 85 | public domain | (dedicated|released|placed|is) (to |in |into )?(in )?the public domain ;; public domain dedication
unlicense | 95 | unlicense | the unlicense ;; released under (the )?unlicense ;; unlicense org
unlicense | 95 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 95 | wtfpl | wtfpl( version 2)? ;; wtfpl licen[cs]e
isc | 90 | isc | isc licen[cs]e ;; licen[cs]e isc
isc | 90 | consortium | internet systems consortium licen[cs]e
isc | 92 | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | 90 | zlib | zlib licen[cs]e ;; zlib libpng licen[cs]e ;; licen[cs]e zlib
zlib | 92 | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 90 | libpng | libpng licen[cs]e( version 2)?
libpng | 90 | png reference | png reference library licen[cs]e
bsl-1.0 | 92 | boost | boost software licen[cs]e( v| version)? 1 0 ;; boost software licen[cs]e ;; boost licen[cs]e
artistic-2.0 | 95 | artistic | artistic licen[cs]e( v| version)? 2( 0)?
artistic-1.0 | 94 | artistic | artistic licen[cs]e( v| version)? 1( 0)?
artistic | 60 | artistic | artistic licen[cs]e
perl | 85 | perl | under the same terms as perl ;; perl licen[cs]e
python-2.0 | 92 | python | python software foundation licen[cs]e( version 2)? ;; python licen[cs]e( 2 0)?
psf-2.0 | 90 | psf | psf licen[cs]e( version 2)? ;; psf 2 0
ruby | 85 | ruby | ruby licen[cs]e ;; same licen[cs]e as ruby ;; ruby s licen[cs]e
php-3.01 | 92 | php | php licen[cs]e( v| version)? 3 01
php-3.0 | 91 | php | php licen[cs]e( v| version)? 3 0
php | 60 | php | php licen[cs]e
openssl | 90 | openssl | openssl licen[cs]e ;; openssl project for use in the openssl toolkit
ssleay | 88 | ssleay | ssleay licen[cs]e ;; original ssleay license
ofl-1.1 | 95 | open font | sil open font licen[cs]e( v| version)? 1 1 ;; open font licen[cs]e( v| version)? 1 1
ofl | 70 | open font | (sil )?open font licen[cs]e
ofl | 70 | ofl | ofl licen[cs]e
eupl-1.2 | 95 | european union | european union public licen[cs]e( v| version)? 1 2
eupl-1.1 | 94 | european union | european union public licen[cs]e( v| version)? 1 1
eupl | 70 | eupl | eupl( v| version)?( 1 [0-2])? ;; eupl licen[cs]e
eupl | 65 | european union | european union public licen[cs]e
cecill-2.1 | 92 | cecill | cecill( free software licen[cs]e)?( v| version)? 2 1
cecill-b | 90 | cecill | cecill b
cecill-c | 90 | cecill | cecill c
cecill | 60 | cecill | cecill( licen[cs]e)?
osl-3.0 | 90 | open software | open software licen[cs]e( v| version)? 3( 0)? ;; open software licen[cs]e
afl-3.0 | 90 | academic free | academic free licen[cs]e( v| version)? 3( 0)? ;; academic free licen[cs]e
ecl-2.0 | 90 | educational community | educational community licen[cs]e( v| version)? 2( 0)? ;; educational community licen[cs]e
ms-pl | 90 | microsoft | microsoft public licen[cs]e( ms pl)? ;; ms pl microsoft
ms-rl | 90 | microsoft | microsoft reciprocal licen[cs]e( ms rl)?
ms-pl | 85 | ms pl | ms pl licen[cs]e ;; (the|under) ms pl
apsl-2.0 | 90 | apple | apple public source licen[cs]e( v| version)?( 2 0)?
qpl-1.0 | 88 | public licen | q public licen[cs]e( v| version)?( 1 0)? ;; qt public licen[cs]e
sleepycat | 88 | sleepycat | sleepycat licen[cs]e ;; sleepycat software
postgresql | 90 | postgresql | postgresql licen[cs]e ;; postgresql database management system formerly known as
ncsa | 90 | ncsa | university of illinois ncsa open source licen[cs]e ;; ncsa open source licen[cs]e ;; ncsa licen[cs]e
upl-1.0 | 90 | universal permissive | universal permissive licen[cs]e( v| version)?( 1 0)?
w3c | 88 | w3c | w3c software notice and licen[cs]e ;; w3c software licen[cs]e ;; w3c document licen[cs]e
vim | 85 | vim | vim licen[cs]e ;; charityware vim
curl | 85 | curl | curl licen[cs]e
jquery | 70 | jquery | jquery org license ;; jquery licen[cs]e
json | 88 | evil | the software shall be used for good not evil
beerware | 90 | beer | beer ?ware licen[cs]e ;; you can buy me a beer in return
fdl-1.3 | 95 | free documentation | gnu free documentation licen[cs]e( v| version)? 1 3
fdl-1.2 | 95 | free documentation | gnu free documentation licen[cs]e( v| version)? 1 2
fdl | 70 | free documentation | (gnu )?free documentation licen[cs]e
odbl-1.0 | 92 | open database | open data commons open database licen[cs]e( v1 0)? ;; open database licen[cs]e( odbl)?
odc-by-1.0 | 92 | open data commons | open data commons attribution licen[cs]e( v1 0)?
pddl-1.0 | 92 | public domain dedication | open data commons public domain dedication and licen[cs]e ;; public domain dedication and licen[cs]e
cdla-permissive-2.0 | 92 | community data | community data licen[cs]e agreement permissive( version)? 2( 0)? ;; community data licen[cs]e agreement permissive
cdla-sharing-1.0 | 92 | community data | community data licen[cs]e agreement sharing( version)?( 1 0)?
ogl-3.0 | 90 | open government | open government licen[cs]e( v| version)? ?v?3( 0)? ;; open government licen[cs]e
oasis | 70 | oasis | oasis ipr policy ;; oasis open licen[cs]e
sspl-1.0 | 92 | server side | server side public licen[cs]e( v| version)?( 1)? ;; sspl v1
busl-1.1 | 92 | business source | business source licen[cs]e( v| version)?( 1 1)?
elastic-2.0 | 92 | elastic | elastic licen[cs]e( v| version)?( 2( 0)?)?
commons-clause | 92 | commons clause | commons clause licen[cs]e condition ;; commons clause
polyform | 88 | polyform | polyform (noncommercial|small business|shield|strict|perimeter)( licen[cs]e)?( 1 0 0)?
openrail | 90 | openrail | (creativeml |bigscience )?open ?rail( m| d| s)?( licen[cs]e)?
openrail | 88 | ai licen | responsible ai licen[cs]e
openrail | 88 | rail licen | bigscience rail licen[cs]e
llama | 85 | community licen | llama [23]( [0-9])? community licen[cs]e( agreement)? ;; llama community licen[cs]e
gemma | 80 | gemma | gemma terms of use
blueoak-1.0.0 | 90 | blue oak | blue oak model licen[cs]e( 1 0 0)?
mulan-psl-2.0 | 90 | mulan | mulan psl( v2)? ;; mulan permissive software licen[cs]e( version 2)?
unicode | 85 | unicode | unicode licen[cs]e( v3)? ;; unicode terms of use ;; unicode inc license agreement
icu | 85 | icu | icu licen[cs]e
ijg | 85 | independent jpeg | independent jpeg group s software ;; independent jpeg group licen[cs]e
freetype | 85 | freetype | freetype (project )?licen[cs]e
imagemagick | 85 | imagemagick | imagemagick licen[cs]e
info-zip | 80 | info zip | info zip licen[cs]e
hpnd | 80 | historical permission | historical permission notice and disclaimer
naumen | 70 | naumen | naumen public licen[cs]e
zpl-2.1 | 85 | zope | zope public licen[cs]e( zpl)?( v| version)?( 2 1)?
spl-1.0 | 80 | sun public | sun public licen[cs]e( v| version)?( 1 0)?
sissl | 80 | sun industry | sun industry standards source licen[cs]e
bcl | 70 | binary code | (sun |oracle )?binary code licen[cs]e( agreement)?
watcom-1.0 | 80 | watcom | sybase open watcom public licen[cs]e( version)?( 1 0)?
rpl-1.5 | 80 | reciprocal public | reciprocal public licen[cs]e( v| version)?( 1 5)?
nasa-1.3 | 80 | nasa | nasa open source agreement( version)?( 1 3)?
cpal-1.0 | 85 | common public attribution | common public attribution licen[cs]e( v| version)?( 1 0)?
lppl-1.3c | 88 | latex | latex project public licen[cs]e( v| version)?( 1 3[abc]?)?
tcl | 75 | tcl | tcl tk licen[cs]e ;; tcl licen[cs]e
intel | 75 | intel | intel open source licen[cs]e ;; intel simplified software licen[cs]e
nvidia | 70 | nvidia | nvidia (software|source code) licen[cs]e( agreement)?
proprietary | 80 | rights reserved | copyright .{0,60}all rights reserved
proprietary | 50 | all rights reserved | all rights reserved
proprietary | 75 | proprietary | proprietary and confidential ;; proprietary licen[cs]e ;; proprietary software licen[cs]e
proprietary | 75 | unauthorized | unauthorized (copying|use|reproduction|distribution) of this .{0,40}(is )?(strictly )?prohibited
commercial | 70 | commercial licen | commercial licen[cs]e( agreement)?
non-commercial | 70 | commercial use | (for )?non commercial use only ;; not for commercial use ;; no commercial use
eula | 70 | end user | end user licen[cs]e agreement
trademark | 30 | registered trademark | registered trademarks? of
no-warranty | 30 | warrant | without warrant(y|ies) of any kind ;; without warranty or conditions of any kind
"""
def rules() -> list[tuple[int, str, int, str, str]]:
    """(order, label, priority, keyword, pattern) for each signature."""
    out = []
    for line in _TEXT.strip().splitlines():
        label, priority, keyword, patterns = (x.strip() for x in line.split(" | "))
        for pattern in patterns.split(" ;; "):
            always = re.sub(r"\([^()]*\)\??", "#", pattern.strip())
            if keyword not in always:
                # this wording lacks the line's keyword: its own longest certain word gates it
                keyword_here = max(re.findall(r"(?<![a-z0-9])[a-z0-9]{2,}(?![a-z0-9?\[])", always), key=len, default="licen")
            else:
                keyword_here = keyword
            out.append((len(out), label, int(priority), keyword_here, pattern.strip()))
    return out


def gate(signatures: list[tuple[int, str, int, str, str]]) -> str:
    """A pattern that any text with a detection matches: a word of each rule's keyword.

    Tried at the starts of words only, and grouped by first letter, so a text costs a few
    steps a word.  Rules that all need the word license share one test; words of up to
    three letters have to stand alone, but for those that versions are written onto.
    """
    letter = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    words = {"licen"}
    for _, _, _, keyword, pattern in signatures:
        if not re.search(r"(?<![a-z])licen", re.sub(r"\([^()]*\)\?", "", pattern)):
            word = max(keyword.split(), key=len)
            alone = len(word) <= 3 and word not in ("gpl", "mpl", "bsd")
            words.add(f"{word}(?!{letter})" if alone else word)
    first: dict[str, list[str]] = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(w[1:])
    return f"(?i)(?<!{letter})(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in first.items())})"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def places(joined: Column, pattern: Column) -> Column:
    """(begin, end) in words of each place where a pattern stands between spaces of ' w0 w1 '."""
    # a place ends before a space, which the next one may begin with
    regex = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    gaps, hits = F.split(joined, regex, -1), F.regexp_extract_all(joined, regex, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        b = s["at"] + _spaces(x["gap"])
        e = b + _spaces(x["hit"])
        return F.when(x["hit"].isNull(), s).otherwise(F.struct(e.alias("at"), F.concat(s["found"], F.array(F.struct(b.alias("b"), e.alias("e")))).alias("found")))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda s: s["found"])


def _base(joined: Column, phrase: str, name: str) -> Column:
    found = F.transform(places(joined, F.lit(phrase)), lambda x: F.struct(x["b"].alias("b"), F.lit(name).alias("label")))
    return F.when(F.contains(joined, F.lit(phrase)), found).otherwise(F.array().cast("array<struct<b:int,label:string>>"))


def _let(value: Column, body) -> Column:
    """The body over a value worked out once: a plain column would be put in place of each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _token(keyword: str) -> str:
    return max(keyword.split(), key=len)


def tokens(joined: Column, signatures: list[tuple[int, str, int, str, str]]) -> Column:
    """Which keyword tokens begin words: one pass, longer tokens first."""
    words = sorted({_token(k) for _, _, _, k, _ in signatures}, key=lambda w: (w[0], -len(w), w))
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(f" ({'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in first.items())})"), F.lit(1)))


def scan_licenses(docs: DataFrame, signatures: list[tuple[int, str, int, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    signatures = rules() if signatures is None else signatures
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = doc_texts(docs).select("doc_id", F.regexp_count(text, F.lit(_ANY_WORD)).cast("long").alias("n_words"), F.when(text.rlike(gate(signatures)), text).alias("some"))
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(_lower(F.col("some")), F.lit(_WORD), F.lit(0)), " "), F.lit(" "))
    rows = rows.select("doc_id", "n_words", joined.alias("j"))
    base = F.concat(*(_base(F.col("j"), p, name) for p, name in BASE))
    # one constant, folded before execution
    table = F.from_json(F.lit(json.dumps([dict(o=o, label=n, p=p, k=k, t=_token(k), x=x) for o, n, p, k, x in signatures])), "array<struct<o:int,label:string,p:int,k:string,t:string,x:string>>")
    j = F.col("j")

    def detections(present: Column) -> Column:
        due = F.filter(table, lambda r: F.exists(present, lambda t: F.startswith(t, r["t"])) & F.contains(j, r["k"]))
        return F.flatten(F.transform(due, lambda r: F.transform(places(j, r["x"]), lambda x: F.struct(r["p"].alias("p"), x["b"].alias("b"), x["e"].alias("e"), r["o"].alias("o"), r["label"].alias("label")))))

    found = _let(tokens(j, signatures), detections)
    there = F.col("j").isNotNull()
    rows = rows.select("doc_id", "n_words", F.when(there, base).alias("base"), F.when(there, found).alias("found"))

    def beaten(d: Column, e: Column) -> Column:
        inside = (e["b"] <= d["b"]) & (e["e"] >= d["e"])
        longer = (e["e"] - e["b"]) > (d["e"] - d["b"])
        first = (e["p"] > d["p"]) | (e["p"] == d["p"]) & (longer | ~longer & (e["o"] < d["o"]))
        return inside & first

    kept = F.filter("found", lambda d: ~F.exists("found", lambda e: beaten(d, e)))
    rows = rows.select("doc_id", "n_words", "base", kept.alias("kept"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined_labels = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))
    begins = F.transform("base", lambda x: x["b"])
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(begins).cast("long").alias("first_word"), F.array_max(begins).cast("long").alias("last_word"),
        joined_labels(labels(F.col("base"))).alias("base_labels"), joined_labels(F.concat(labels(F.col("base")), labels(F.col("kept")))).alias("labels"),
        (F.coalesce(F.greatest(F.array_max(F.transform("kept", lambda x: x["p"])), F.when(F.size("base") > 0, 60)), F.lit(0)) / 100.0).alias("score"),
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_detections"),
    )
