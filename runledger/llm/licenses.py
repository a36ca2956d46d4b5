"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a keyword that must stand in the text for
it to be tried, a label, a priority and a weight. All keywords are looked up in
one pass of an automaton, over the text with every run of white space and
comment marks as one blank, as the expressions take any between words.
Detections that lie inside another one of the same or a higher priority give
way. There are five families: identifier tags, whose expressions are read by
their grammar; sentences of the licences themselves; grants, addresses and
names in running text; short forms; and bare identifiers.
"""

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runledger.llm import textops

# The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# One line per licence: label, keyword, name as written in running text, short
# identifiers, and a part of its usual address.
LICENSES = [
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", r"agpl-[13]\.0", r"gnu\.org/licenses/agpl"),
    ("lgpl", "lesser", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", r"lgpl-[23]\.[01]", r"gnu\.org/licenses/lgpl"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", r"gpl-[123]\.0", r"gnu\.org/licenses/gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl-1\.[123]", r"gnu\.org/licenses/fdl"),
    ("mit", "mit", r"mit(?: open source)? licen[sc]e", r"mit(?:-0)?", r"opensource\.org/licenses/mit"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", r"apache-[12]\.[01]", r"apache\.org/licenses/"),
    ("bsd", "bsd", r"(?:[234]-clause )?bsd(?: [234]-clause)?(?: simplified| revised| new)? licen[sc]e", r"bsd-[0-4]-clause(?:-[a-z]+)*", r"opensource\.org/licenses/bsd"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mpl-[12]\.[01]", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[sc]e", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    ("cpl", "common public", r"common public licen[sc]e", r"cpl-1\.0", r"opensource\.org/licenses/cpl"),
    ("cpal", "attribution", r"common public attribution licen[sc]e", r"cpal-1\.0", r"opensource\.org/licenses/cpal"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "cc by-nc-nd", r"cc by-nc-nd(?: [1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "cc by-nc-sa", r"cc by-nc-sa(?: [1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "cc by-nc", r"cc by-nc(?: [1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "cc by-nd", r"cc by-nd(?: [1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "cc by-sa", r"cc by-sa(?: [1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "cc by", r"cc by(?: [1-4]\.[05])?", r"cc-by-[1-4]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("creative-commons", "creative commons", r"creative commons(?:(?: |-)(?:attribution|non-?commercial|commercial|non|share-?alike|share|alike|no-?deriv(?:ative)?s|no|derivatives|zero|by|nc|nd|sa|and|v?[1-4]\.[05]|international|unported|generic|universal|public|domain|dedication))* licen[sc]e", r"cc-pddc", r"creativecommons\.org/licenses"),
    ("isc", "isc", r"isc licen[sc]e", r"isc", r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"opensource\.org/licenses/zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "do what the", r"do what the f\w+ you want to public licen[sc]e", r"wtfpl", r"wtfpl\.net"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic licen[sc]e", r"artistic-[12]\.0", r"opensource\.org/licenses/artistic"),
    ("boost", "boost", r"boost software licen[sc]e", r"bsl-1\.0", r"boost\.org/license"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql", r"opensource\.org/licenses/postgresql"),
    ("python", "python", r"python(?: software foundation)? licen[sc]e", r"(?:psf|python)-2\.0", r"python\.org/(?:3/)?license"),
    ("php", "php", r"php licen[sc]e", r"php-3\.01?", r"php\.net/license"),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby", r"ruby-lang\.org/\w+/about/license"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[sc]e", r"ssleay", r"cryptsoft\.com"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("eupl", "european union", r"european union public licen[sc]e", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("osl", "open software", r"open software licen[sc]e", r"osl-[123]\.[01]", r"opensource\.org/licenses/osl"),
    ("afl", "academic free", r"academic free licen[sc]e", r"afl-[123]\.[012]", r"opensource\.org/licenses/afl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[sc]e", r"ncsa", r"opensource\.org/licenses/(?:uoi-)?ncsa"),
    ("qpl", "q public", r"q public licen[sc]e", r"qpl-1\.0", r"opensource\.org/licenses/qpl"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", r"sleepycat", r"opensource\.org/licenses/sleepycat"),
    ("vim", "vim", r"vim licen[sc]e", r"vim", r"vimhelp\.org/uganda"),
    ("x11", "x11", r"x11 licen[sc]e", r"x11", r"x\.org/\S*license"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e", r"w3c", r"w3\.org/consortium/legal"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain dedication", r"public domain dedication (?:and )?licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("beerware", "beer", r"beer-?ware licen[sc]e", r"beerware", r"people\.freebsd\.org/~phk"),
    ("json", "json", r"json licen[sc]e", r"json", r"json\.org/license"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", r"upl-1\.0", r"opensource\.org/licenses/upl"),
    ("mulan", "mulan", r"mulan (?:permissive software|public) licen[sc]e", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e", r"cecill-\w+(?:\.\d)?", r"cecill\.info"),
    ("ecl", "educational community", r"educational community licen[sc]e", r"ecl-[12]\.0", r"opensource\.org/licenses/ecl"),
    ("sspl", "server side", r"server side public licen[sc]e", r"sspl-1\.0", r"mongodb\.com/licensing"),
    ("busl", "business source", r"business source licen[sc]e", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("elastic", "elastic", r"elastic licen[sc]e", r"elastic-2\.0", r"elastic\.co/licensing"),
    ("openrail", "openrail", r"(?:creativeml )?(?:bigscience )?openrail(?:-m)? licen[sc]e", r"(?:bigscience-)?openrail(?:-m)?", r"huggingface\.co/spaces/\S*license"),
]

# One line per short form: label, keyword, expression.
SHORT_FORMS = [
    ("gpl", "gpl", r"(?:gnu )?gpl(?:,? ?(?:version|v)\.? ?|-| )?[123](?:\.[0-9])?(?:\+| or later| or any later version| only)?"),
    ("gpl", "gnu gpl", r"gnu gpl"),
    ("gpl", "gpl", r"gpl(?:-| )(?:licen[sc]ed|compatible|only)"),
    ("gpl", "gpl", r"the gpl(?: licen[sc]e)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:,? ?(?:version|v)\.? ?|-| )?[23](?:\.[01])?(?:\+| or later| or any later version| only)?"),
    ("lgpl", "gnu lgpl", r"gnu lgpl"),
    ("lgpl", "lgpl", r"lgpl(?:-| )licen[sc]ed"),
    ("lgpl", "lesser gpl", r"(?:gnu )?lesser gpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?:,? ?(?:version|v)\.? ?|-| )?[13](?:\.0)?(?:\+| or later| or any later version| only)?"),
    ("agpl", "gnu agpl", r"gnu agpl"),
    ("agpl", "agpl", r"agpl(?:-| )licen[sc]ed"),
    ("agpl", "affero gpl", r"(?:gnu )?affero gpl"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: v?[0-9]\.[0-9])?"),
    ("gfdl", "gnu fdl", r"gnu fdl"),
    ("mit", "mit", r"mit(?:-| )licen[sc]ed"),
    ("mit", "mit", r"mit(?:-| )style licen[sc]e"),
    ("mit", "mit", r"mit/x11(?: licen[sc]e)?"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit", "mit", r"licen[sc]e: mit"),
    ("mit", "mit", r"(?:licen[sc]ed|released|available|distributed) under (?:the )?mit"),
    ("apache", "apache", r"apache(?:-| )licen[sc]ed"),
    ("apache", "apache", r"apache,? ?(?:version |v\.? ?)?[12]\.[01]"),
    ("apache", "apache", r"apache ?v2"),
    ("apache", "apache", r"licen[sc]e: apache"),
    ("apache", "asl", r"asl(?: ?v?|-)(?:1\.1|2(?:\.0)?)"),
    ("apache", "al2", r"al2\.0"),
    ("bsd", "clause", r"(?:[0234]|zero|two|three|four)[ -]clause bsd"),
    ("bsd", "bsd", r"bsd[ -](?:[0234]|zero|two|three|four)[ -]clause"),
    ("bsd", "bsd", r"bsd(?:-| )licen[sc]ed"),
    ("bsd", "bsd", r"bsd(?:-| )(?:style|like|type) licen[sc]e"),
    ("bsd", "bsd", r"(?:new|modified|revised|simplified|original|old|free)(?:-| )bsd licen[sc]e"),
    ("bsd", "freebsd", r"freebsd (?:copyright|documentation licen[sc]e|licen[sc]e)"),
    ("bsd", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"licen[sc]e: bsd"),
    ("mpl", "mpl", r"mpl(?:,? ?(?:version|v)\.? ?|-| )?[12]\.[01]"),
    ("mpl", "mplv2", r"mplv2"),
    ("mpl", "mpl", r"mpl(?:-| )licen[sc]ed"),
    ("mpl", "mozilla", r"mozilla licen[sc]e"),
    ("epl", "epl", r"epl(?: v?\.? ?)[12]\.0"),
    ("epl", "epl", r"epl(?:-| )licen[sc]ed"),
    ("cddl", "cddl", r"cddl(?: v?\.? ?)1\.[01]"),
    ("cddl", "cddl", r"cddl(?:-| )licen[sc]ed"),
    ("cc0", "cc0", r"cc(?:-| )zero"),
    ("cc0", "creative commons zero", r"creative commons zero"),
    ("cc0", "cc0", r"cc0(?:-| )licen[sc]ed"),
    ("cc-by", "cc-by", r"cc-by(?: v?[1-4]\.[05])?"),
    ("cc-by-sa", "cc-by-sa", r"cc-by-sa(?: v?[1-4]\.[05])?"),
    ("cc-by-nd", "cc-by-nd", r"cc-by-nd(?: v?[1-4]\.[05])?"),
    ("cc-by-nc", "cc-by-nc", r"cc-by-nc(?: v?[1-4]\.[05])?"),
    ("cc-by-nc-sa", "cc-by-nc-sa", r"cc-by-nc-sa(?: v?[1-4]\.[05])?"),
    ("cc-by-nc-nd", "cc-by-nc-nd", r"cc-by-nc-nd(?: v?[1-4]\.[05])?"),
    ("cc-by-sa", "sharealike", r"attribution-sharealike(?: v?[1-4]\.[05])?"),
    ("cc-by-nd", "noderiv", r"attribution-noderiv(?:ative)?s(?: v?[1-4]\.[05])?"),
    ("cc-by-nc", "noncommercial", r"attribution-non-?commercial(?: v?[1-4]\.[05])?"),
    ("cc-by-nc-sa", "sharealike", r"attribution-non-?commercial-sharealike(?: v?[1-4]\.[05])?"),
    ("cc-by-nc-nd", "noderiv", r"attribution-non-?commercial-noderiv(?:ative)?s(?: v?[1-4]\.[05])?"),
    ("creative-commons", "creative commons", r"under (?:a )?creative commons"),
    ("isc", "isc", r"isc(?:-| )licen[sc]ed"),
    ("isc", "isc", r"isc-style licen[sc]e"),
    ("isc", "isc", r"licen[sc]e: isc"),
    ("zlib", "zlib", r"zlib(?:-| )licen[sc]ed"),
    ("zlib", "libpng", r"libpng licen[sc]e"),
    ("unlicense", "unlicense", r"unlicensed? into the public domain"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v?[0-9](?:\.[0-9])?)?"),
    ("artistic", "artistic", r"same terms as perl(?: itself)?(?: and the artistic licen[sc]e)"),
    ("artistic", "perl", r"(?:under )?the same terms as perl(?: itself)?"),
    ("boost", "boost", r"boost licen[sc]e"),
    ("boost", "boost", r"boost(?:-| )licen[sc]ed"),
    ("python", "psf", r"psf licen[sc]e"),
    ("python", "psf", r"psfl(?: v?2)?"),
    ("php", "php", r"php(?:-| )licen[sc]ed"),
    ("openssl", "openssl", r"dual openssl and ssleay"),
    ("ofl", "ofl", r"(?:sil )?ofl(?: v?1\.[01])?"),
    ("ms-pl", "ms-pl", r"ms-pl"),
    ("ms-rl", "ms-rl", r"ms-rl"),
    ("eupl", "eupl", r"eupl(?: v?\.? ?1\.[012])?"),
    ("osl", "osl", r"osl(?: v?\.? ?)[123]\.[01]"),
    ("afl", "afl", r"afl(?: v?\.? ?)[123]\.[012]"),
    ("ncsa", "illinois", r"university of illinois open source licen[sc]e"),
    ("odbl", "odbl", r"odbl(?: v?1\.0)?"),
    ("odc-by", "odc-by", r"odc-by(?: v?1\.0)?"),
    ("pddl", "pddl", r"pddl(?: v?1\.0)?"),
    ("beerware", "beer", r"beer-?ware"),
    ("mulan", "mulan", r"mulan ?psl(?: ?v[12])?"),
    ("cecill", "cecill", r"cecill(?:-[abc])? v?[12](?:\.[01])?"),
    ("sspl", "sspl", r"sspl(?: ?v1)?"),
    ("busl", "busl", r"busl(?: v?1\.1)?"),
    ("elastic", "elastic", r"elastic licen[sc]e v2"),
    ("openrail", "openrail", r"openrail(?:-m|\+\+)?"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put|given) (?:in)?to the public domain"),
    ("public-domain", "public domain", r"(?:is|are) (?:hereby )?in the public domain"),
    ("public-domain", "public domain", r"public domain (?:work|software|code|file)"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "proprietary", r"proprietary licen[sc]e"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file"),
]

# One line per sentence: label, a word of it, and the words as the licence has
# them, without names of holders.
BODIES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("x11", "otherwise", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "endorse", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "regents", "this software is provided by the regents and contributors as is"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "hereby", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "disclaims", "the software is provided as is and isc disclaims all warranties with regard to this software"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "licenses", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "permit", "the gnu general public license does not permit incorporating your program into proprietary programs"),
    ("lgpl", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "library", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl", "incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public license"),
    ("mpl", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "constitutes", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("edl", "eclipse", "made available under the terms of the eclipse distribution license"),
    ("cddl", "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "cddl", "when distributing covered code include this cddl header notice in each file"),
    ("cpl", "common", "the accompanying program is provided under the terms of this common public license"),
    ("cpal", "attribution", "the contents of this file are subject to the common public attribution license"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights to"),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("creative-commons", "exercising", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions"),
    ("creative-commons", "commons", "creative commons corporation is not a law firm and does not provide legal services"),
    ("creative-commons", "commons", "the work as defined below is provided under the terms of this creative commons public license"),
    ("creative-commons", "commons", "this work is licensed under a creative commons"),
    ("zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "detriment", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("artistic", "semblance", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("boost", "accompanying", "any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "boost", "distributed under the boost software license"),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python", "python", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python", "psf", "psf is making python available to licensee on an as is basis"),
    ("python", "cnri", "governed by the federal intellectual property law of the united states as between you and cnri"),
    ("php", "php", "products derived from this software may not be called php nor may php appear in their name"),
    ("php", "php", "this product includes php software freely available from"),
    ("ruby", "modifications", "you may redistribute your version of the software provided that you do at least one of the following place your modifications in the public domain"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl", "products derived from this software may not be called openssl nor may openssl appear in their names"),
    ("ssleay", "eric", "this product includes cryptographic software written by eric young"),
    ("ssleay", "aheared", "this library is free for commercial and non commercial use as long as the following conditions are aheared to"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "font", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ms-pl", "accept", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal", "reciprocal grants for any file you distribute that contains code from the software"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("osl", "open", "licensed under the open software license version"),
    ("afl", "academic", "licensed under the academic free license version"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("qpl", "applies", "this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", "obtaining", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("w3c", "w3c", "notice of any changes or modifications to the w3c files including the date changes were made"),
    ("odbl", "database", "is made available under the open database license"),
    ("odc-by", "attribution", "is made available under the open data commons attribution license"),
    ("pddl", "dedication", "is made available under the public domain dedication and license"),
    ("beerware", "retain", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("upl", "larger", "a copy of the software and or the larger works to which the software is contributed"),
    ("upl", "licensable", "any and all patent rights owned or freely licensable by each licensor hereunder"),
    ("mulan", "mulan", "is licensed under mulan psl"),
    ("cecill", "french", "license under french law and abiding by the rules of distribution of free software"),
    ("ecl", "educational", "licensed under the educational community license version"),
    ("sspl", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", "managed", "you may not provide the software to third parties as a hosted or managed service"),
    ("openrail", "restrictions", "use based restrictions as referenced in paragraph"),
    ("public-domain", "disclaims", "the author disclaims copyright to this source code"),
    ("public-domain", "blessing", "in place of a legal notice here is a blessing"),
    ("public-domain", "domain", "i the copyright holder of this work release this work into the public domain"),
    ("proprietary", "proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "trade", "contains trade secrets and proprietary information"),
    ("proprietary", "reproduced", "no part of this publication may be reproduced stored in a retrieval system or transmitted"),
]

VERSION = r"(?:,? (?:version |v\.? ?)?[0-9](?:\.[0-9]{1,2})?)?"
# What makes a name before it something else than a software licence.
NO_LICENSE = r"(?! (?:plates?|numbers?|fees?|keys?|servers?|renewals?|holders?|exams?|tests?)(?!\w))"
# Kind, priority, weight and expression of the rules of every licence.
KINDS = [
    ("grant", 30, 0.95, r"(?:licen[sc]ed|distributed|released|available|published) under (?:the )?(?:terms of )?(?:the )?{name}{version}{no_license}"),
    ("link", 20, 0.85, r"(?:https?://)?(?:www\.)?{address}\S*+"),
    ("title", 10, 0.6, r"(?:the )?{name}{version}{no_license}"),
]
TAG, BODY, SHORT, BARE = (40, 0.99), (25, 0.9), (8, 0.6), (9, 0.8)
_GAP = r"(?:\s++(?:(?:[#*;%!>|]++|//++|--++)\s*+)*+)"
_MARKS = bytes.maketrans(b"#*;%!>|/", b" " * 8)
_SUFFIX = r"(?:-only|-or-later|\+)?"
IDENTIFIERS = [(label, re.compile("(?:" + ids + ")" + _SUFFIX)) for label, _, _, ids, _ in LICENSES]
# Identifiers that are no words of running text, beside those with a digit.
PLAIN_IDENTIFIERS = ("mit", "isc", "unlicense", "zlib", "ncsa")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9.+-]+)")
_JOINED = re.compile(r"(?<![\w.+-])\(?[a-z0-9.+-]+ +(?:and|or|with) +(?=\(?[a-z0-9])")


def _spaced(text):
    """An expression whose blanks take any white space, with comment marks at line starts."""
    return re.sub(r"(?<!\[)(?<!\[\\w) (?![\]-])", lambda _: _GAP, text)


def _sentence(words):
    """Words with anything but words between them."""
    return r"\W++".join(words.split()) + r"(?!\w)"


def _literal(ids):
    """Characters that every identifier of an expression holds."""
    return re.match(r"[a-z0-9-]*", ids).group() or re.search(r"\)(.*)", ids)[1].replace("\\", "")


def rules():
    """[(keyword, expression, label, priority, weight)], highest priority first."""
    found = []
    for label, keyword, name, ids, address in LICENSES:
        for kind, priority, weight, form in KINDS:
            text = _spaced(form.format(name=name, address=address, version=VERSION, no_license=NO_LICENSE))
            needed = address.split("/")[0].replace("\\", "") if kind == "link" else keyword
            found.append((needed, re.compile(r"(?<!\w)(?:" + text + r")(?!\w)"), label, priority, weight))
        if re.search(r"[0-9]|\\w", ids):  # others are words of running text
            digit = r"(?=[a-z-]*[0-9])" if re.search(r"\?$|\\w", ids) else ""
            found.append((_literal(ids), re.compile(r"(?<![\w.-])" + digit + "(?:" + ids + ")" + _SUFFIX + r"(?![\w-])"), label, *BARE))
    found += [(keyword, re.compile(r"(?<![\w-])(?:" + _spaced(form + NO_LICENSE) + r")(?![\w-])"), label, *SHORT) for label, keyword, form in SHORT_FORMS]
    found += [(keyword, re.compile(_sentence(words)), label, *BODY)
              for label, keyword, words in BODIES]
    return sorted(found, key=lambda r: -r[3])


EXPRESSION_KEYWORDS = frozenset(_literal(ids) for _, _, _, ids, _ in LICENSES if re.search("[0-9]", ids)) | set(PLAIN_IDENTIFIERS)


def keyword_index(ordered):
    """An automaton that finds the keywords of all rules in one pass."""
    index = ahocorasick.Automaton()
    for keyword in {r[0] for r in ordered} | {"spdx-license-identifier", *EXPRESSION_KEYWORDS}:
        if keyword:
            index.add_word(keyword, keyword)
    index.make_automaton()
    return index


@lru_cache(1 << 14)
def _labels(identifier):
    return [label for label, ids in IDENTIFIERS if ids.fullmatch(identifier)]


def identifiers(text, place):
    """([(start, end, label)], end) of the identifier expression at a place of a lower-case text.

    Identifiers are joined by and, or, with (an exception follows, which has no
    label) and parentheses; the expression ends where this form does, at the
    latest with its line. Identifiers that no licence here has are passed over.
    """
    found, depth, operand, exception = [], 0, True, False
    while m := _TOKEN.match(text, place):
        token, place = m[1], m.end()
        if operand:
            if token == "(":
                depth += 1
                continue
            trimmed = token.rstrip(".-")
            if not trimmed or token in (")", "and", "or", "with"):
                break
            if not exception:
                found += [(m.start(1), m.start(1) + len(trimmed), label) for label in _labels(trimmed)]
            if trimmed != token:
                break
            operand = exception = False
        elif token == ")" and depth:
            depth -= 1
        elif token in ("and", "or", "with"):
            operand, exception = True, token == "with"
        else:
            break
    return found, place


def _expressions(text, present):
    """Detections of tagged identifier expressions, and of joined ones without a tag."""
    hits = []
    if "spdx-license-identifier" in present:
        for m in re.finditer(r"spdx-license-identifier:", text):
            hits += [(*span, *TAG) for span in identifiers(text, m.end())[0]]
    if present & EXPRESSION_KEYWORDS:
        done = 0
        for m in _JOINED.finditer(text):
            if m.start() >= done:
                spans, done = identifiers(text, m.start())
                names = [text[a:b] for a, b, _ in spans]
                if len(spans) > 1 and (any(re.search("[0-9]", n) for n in names) or all(n in PLAIN_IDENTIFIERS for n in names)):
                    hits += [(*span, *BARE) for span in spans]
    return hits


def lower(text):
    return text.translate({c: c + 32 for c in range(0x41, 0x5B)})


def detect(text, ordered, index=None):
    """[(start, end, label, weight)] left after suppression; text in lower case."""
    marked = text.encode("utf-8", "replace").translate(_MARKS).decode().replace("--", " ")
    folded = " ".join(marked.split())
    present = {k for _, k in (index or keyword_index(ordered)).iter(folded)}
    hits = [(-priority, start - end, start, end, label, weight)
            for start, end, label, priority, weight in _expressions(text, present)]
    for keyword, expression, label, priority, weight in ordered:
        if not keyword or keyword in present:
            hits += [(-priority, m.start() - m.end(), m.start(), m.end(), label, weight) for m in expression.finditer(text)]
    # Of the kept intervals those inside no other one: starts and ends both rise.
    kept, starts, ends = [], [], []
    for _, _, start, end, label, weight in sorted(hits):  # by priority, then the longest
        place = bisect_right(starts, start)
        if place and ends[place - 1] >= end:
            continue
        kept.append((start, end, label, weight))
        first, last = bisect_left(starts, start), bisect_right(ends, end)
        starts[first:last], ends[first:last] = [start], [end]
    return sorted(kept)


def _base_rules():
    edge, gap = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
    return [(phrase.split()[-1].encode(), label, re.compile(
        rb"(?<!" + edge + rb")" + gap.join(w.encode() for w in phrase.split()) + rb"(?!" + edge + rb")"))
        for phrase, label in PHRASES]


def scan(docs):
    """Per row of docs(doc_id, text): words, base places, and the detections of the rules.

    Columns: doc_id, n_words, n_base, first_word, last_word (of the base places,
    else null), base_labels, labels (arrays, distinct and sorted), score (one
    minus the product of the doubts of all detections, base places counting as
    titles) and detections (start, end, label in code points). Null text is
    empty; empty texts have no labels and score 0. Rows are judged one by one,
    so repeated rows and ids do no harm; an empty table gives no rows.
    """
    def run(batches):
        ordered, base = rules(), _base_rules()
        index = keyword_index(ordered)
        title = KINDS[-1][2]
        for chunk in textops.chunks(batches):
            data, bounds = textops.text_bytes(chunk.column("text"))
            data = textops.LOWER[data]
            starts, _, before = textops.word_spans(data, bounds, textops.ALNUM)
            whole = data.tobytes()
            out = []
            for a, b, words in zip(bounds.tolist(), bounds[1:].tolist(), zip(before, before[1:])):
                raw = whole[a:b]
                places, doubts = [], 1.0
                for keyword, label, expression in base:
                    if keyword in raw:
                        places += [(int(np.searchsorted(starts, a + m.start()) - words[0]), label) for m in expression.finditer(raw)]
                found = detect(raw.decode("utf-8", "replace"), ordered, index)
                for weight in [title] * len(places) + [w for *_, w in found]:
                    doubts *= 1 - weight
                at = [p for p, _ in places]
                labels = {label for _, label in places}
                out.append((int(words[1] - words[0]), len(places), min(at, default=None), max(at, default=None),
                            sorted(labels), sorted(labels | {d[2] for d in found}), 1 - doubts,
                            [{"start": s, "end": e, "label": n} for s, e, n, _ in found]))
            columns = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), DETECTION]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
             "labels array<string>, score double, detections array<struct<start:int,end:int,label:string>>")


DETECTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
