"""License names, notices and clauses, written out: (label, keyword, phrase).

A phrase is a regex over text in lower case; its single spaces stand for any
white space. The keyword is a word that every match holds.
"""

NAMES = [
    ("0bsd", "0bsd", "0bsd license"), ("0bsd", "zero-clause", "bsd zero-clause"), ("adobe", "adobe", "adobe systems open source code license"), ("aladdin", "aladdin", "aladdin free public license"),
    ("apsl", "apple", "apple public source license"), ("apl", "adaptive", "adaptive public license"), ("bittorrent", "bittorrent", "bittorrent open source license"), ("blueoak", "oak", "blue oak model license"),
    ("busl", "business", "business source license"), ("bsl", "boost", "distributed under the boost software license"), ("cecill", "cecill", "cecill(?:-[abc])? (?:free software )?licen[cs]e"), ("clear-bsd", "clear", "clear bsd license"),
    ("cnri", "cnri", "cnri (?:open source |python )?license"), ("commons-clause", "clause", "commons clause (?:license )?condition"), ("cua", "cua", "cua office public license"), ("ecos", "ecos", "ecos license"),
    ("elastic", "elastic", "elastic license(?: 2\\.0)?"), ("entessa", "entessa", "entessa public license"), ("eudatagrid", "datagrid", "eu datagrid software license"), ("fair", "fair", "fair license"),
    ("frameworx", "frameworx", "frameworx open license"), ("freetype", "freetype", "freetype (?:project )?license"), ("ftl", "freetype", "portions of this software are copyright ©? ?\\d\\d\\d\\d the freetype project"), ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("ibm-pl", "ibm", "ibm public license"), ("icu", "icu", "icu license"), ("ijg", "jpeg", "independent jpeg group"), ("imagemagick", "imagemagick", "imagemagick license"),
    ("info-zip", "info-zip", "info-zip license"), ("intel", "intel", "intel open source license"), ("ipa", "ipa", "ipa font license"), ("jasper", "jasper", "jasper license"),
    ("lpl", "lucent", "lucent public license"), ("mirosl", "miros", "miros licence"), ("ms-pl", "microsoft", "microsoft public license"), ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("motosoto", "motosoto", "motosoto open source license"), ("mulan", "mulan", "mulan (?:permissive software license|psl)"), ("multics", "multics", "multics license"), ("nasa", "nasa", "nasa open source agreement"),
    ("naumen", "naumen", "naumen public license"), ("nethack", "nethack", "nethack general public license"), ("nokia", "nokia", "nokia open source license"), ("nosl", "netizen", "netizen open source license"),
    ("npl", "netscape", "netscape public license"), ("ntp", "ntp", "ntp license"), ("oclc", "oclc", "oclc research public license"), ("ogl", "government", "open government licen[cs]e"),
    ("oldap", "openldap", "openldap public license"), ("oset", "oset", "oset public license"), ("parity", "parity", "parity public license"), ("pddl", "pddl", "pddl license"),
    ("pddl", "dedication", "public domain dedication and license"), ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter|free trial) license"), ("qpl", "public", "q public license"), ("rpl", "reciprocal", "reciprocal public license"),
    ("rpsl", "realnetworks", "realnetworks public source license"), ("rscpl", "ricoh", "ricoh source code public license"), ("sgi", "sgi", "sgi free software license"), ("simpl", "simple", "simple public license"),
    ("sissl", "industry", "sun industry standards source license"), ("sleepycat", "sleepycat", "sleepycat license"), ("spl", "sun", "sun public license"), ("sspl", "side", "server side public license"),
    ("sugarcrm", "sugarcrm", "sugarcrm public license"), ("tcl", "tcl", "tcl/tk license"), ("unicode", "unicode", "unicode(?:, inc\\.)? license agreement"), ("upl", "universal", "universal permissive license"),
    ("vostrom", "vostrom", "vostrom public license"), ("vsl", "vovida", "vovida software license"), ("w3c", "w3c", "w3c software (?:notice and|and document) license"), ("watcom", "watcom", "sybase open watcom public license"),
    ("wxwindows", "wxwindows", "wxwindows library licen[cs]e"), ("xfree86", "xfree86", "xfree86 license"), ("xnet", "x.net", "x\\.net license"), ("zed", "zed", "zed license"),
    ("etalab", "etalab", "licence ouverte(?: /)? etalab"), ("odc-by", "attribution", "open data commons attribution license"), ("cdla", "agreement", "community data license agreement"), ("openrail", "openrail", "(?:creativeml )?openrail(?:-m)?(?: license)?"),
    ("llama", "llama", "llama(?: [23](?:\\.\\d)?)? community license"), ("gemma", "gemma", "gemma terms of use"), ("anti-996", "anti", "anti[ -]996 license"), ("hippocratic", "hippocratic", "hippocratic license"),
]
CLAUSES = [
    ("mit", "deal", "to deal in the software without restriction"), ("mit", "merge", "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"), ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"), ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice"), ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"), ("isc", "fee", "for any purpose with or without fee is hereby granted"), ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"), ("gpl", "redistribute", "you can redistribute it and/or modify it under the terms of the gnu general public license"), ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received", "you should have received a copy of the gnu general public license"), ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"), ("agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"), ("apache", "agreed", "unless required by applicable law or agreed to in writing"), ("apache", "contributor", "contributor license agreements"),
    ("mpl", "subject", "this source code form is subject to the terms of the mozilla public license"), ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"), ("boost", "execute", "to use, reproduce, display, distribute, execute, and transmit the software"),
    ("artistic", "package", "the standard version of the package"), ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"), ("unlicense", "dedicate", "dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", "waive", "waives? all (?:of his or her )?(?:copyright|rights)(?: to the work)?"), ("public-domain", "disclaims", "the author disclaims copyright to this source code"), ("public-domain", "copyright", "no copyright is claimed"), ("beerware", "beer", "you can buy me a beer in return"),
    ("cc-by", "commons", "licensed under a creative commons attribution (?:[1234]\\.[05] )?(?:international )?licen[cs]e"), ("cc-by-sa", "share", "share ?alike licen[cs]e"), ("cc-by-nc", "noncommercial", "for noncommercial (?:use|purposes) only"), ("cc-by-nc", "commercial", "not for commercial use"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)"), ("proprietary", "reproduced", "no part of this (?:publication|book|document|work) may be reproduced"), ("proprietary", "permission", "without the (?:prior |express )?written permission of"),
    ("proprietary", "confidential", "confidential and proprietary information"), ("proprietary", "trade", "contains trade secrets"), ("proprietary", "redistributed", "may not be (?:copied|reproduced) or redistributed"), ("eula", "end-user", "end-user license agreement"), ("eula", "installing", "by installing(?: or using)? this software"),
    ("public-domain", "government", "a work of the united states government"), ("ogl-uk", "licensed", "contains public sector information licensed under"), ("odbl", "database", "made available under the open database license"), ("ofl", "reserved", "with reserved font name"),
    ("disclaimer", "warranties", "without warranties or conditions of any kind"), ("disclaimer", "provided", "provided (?:\"as is\"|'as is'|“as is”|``as is''|as is),? without (?:any )?(?:express or implied )?warrant(?:y|ies)"), ("disclaimer", "event", "in no event shall the (?:author|authors|copyright holder|copyright holders|regents)"),
]
#: Clauses that more than one license has say little.
WEAK = {"disclaimer", "copyright", "proprietary", "eula"}
