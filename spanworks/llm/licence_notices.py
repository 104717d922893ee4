"""Notices and texts of licences, and the terms by which they differ."""

from __future__ import annotations

import re
from importlib.resources import files

_FIRST: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("all-rights-reserved", "All rights reserved."),
)
_MORE: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
                "this file except in compliance with the License."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "This work is licensed under CC0 1.0 Universal, Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    *(("GFDL-" + v, "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
       f"Documentation License, Version {v} or any later version published by the Free Software Foundation") for v in ("1.2", "1.3")),
)
_GNU = (
    ("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"),
    ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
)
_CC = (("", ""), ("-NC", "-NonCommercial"), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"),
       ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
_CC_VERSIONS = (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))


def _families():
    for label, kind, v in _GNU:
        name = f"GNU {kind}General Public License"
        yield label, f"This work is licensed under the {name}, version {v}."
        yield label, f"{name}, version {v}"
        yield label, (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published "
                      f"by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
        yield label, (f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} "
                      f"version {v} as published by the Free Software Foundation.")
    for short, long in _CC:
        for v, scope in _CC_VERSIONS:
            yield f"CC-BY{short}-{v}", f"Licensed under CC BY{short} {v}."
            yield f"CC-BY{short}-{v}", f"This work is licensed under a Creative Commons Attribution{long} {v} {scope} License."
    for label in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "EPL-2.0"):
        yield label, f"SPDX-License-Identifier: {label}"
    for label, _, _ in _GNU:
        for end in ("", "-only", "-or-later"):
            yield label, f"SPDX-License-Identifier: {label}{end}"
    for short, _ in _CC:
        yield f"CC-BY{short}-4.0", f"SPDX-License-Identifier: CC-BY{short}-4.0"


#: Notices by which texts name their licence. The first of equally similar ones counts.
TEMPLATES: tuple[tuple[str, str], ...] = (*_FIRST, *_MORE, *_families())

_NAMES = {name: re.compile(rule) for name, rule in {
    "gnu": r"\bgnu\b|\b[al]?gpl", "lesser": r"\blesser\b|\blgpl(?!-2\.0)", "library": r"\blibrary general public|\blgpl-2\.0",
    "affero": r"\baffero\b|\bagpl", "fdl": r"\bfree documentation\b|\bgfdl", "apache": r"\bapache\b",
    "mit": r"\bmit licen[cs]e|\b(?:licen[cs]e|identifier) mit\b", "bsd": r"\bbsd\b", "two": r"\b2-clause", "three": r"\b3-clause",
    "mozilla": r"\bmozilla\b|\bmpl\b", "eclipse": r"\beclipse\b|\bepl\b", "isc": r"\bisc\b", "boost": r"\bboost\b|\bbsl\b",
    "cc": r"\bcreative commons\b|\bcc[ -]by\b|\battribution\b", "zero": r"\bcc0\b|\bcc zero\b", "unlicense": r"\bunlicen[cs]e\b",
    "nc": r"\bnon-?commercial\b|\bby(?:[ -](?:sa|nd))*[ -]nc\b", "sa": r"\bshare-?alike\b|\bby(?:[ -](?:nc|nd))*[ -]sa\b",
    "nd": r"\bno-?deriv|\bby(?:[ -](?:nc|sa))*[ -]nd\b",
}.items()}
_VERSION = re.compile(r"(?:(?<![\w.])|(?<=gpl)|(?<=mpl))v?(\d(?:\.\d)?)(?!\w)(?!\.\d)(?!-clause)")
_SIGNS = re.compile(r"[^a-z0-9.+-]+")


def plain(text: str) -> str:
    """Lower case without signs, line breaks and comment marks."""
    return _SIGNS.sub(" ", text.lower())


def terms(text: str) -> tuple[frozenset[str], frozenset[str]]:
    """The licences and variants that a notice names, and the versions."""
    text = plain(text)
    return (
        frozenset(name for name, rule in _NAMES.items() if rule.search(text)),
        frozenset(v.removesuffix(".0") for v in _VERSION.findall(text)))


def agree(text: tuple[frozenset[str], frozenset[str]], notice: tuple[frozenset[str], frozenset[str]]) -> bool:
    return text[0] == notice[0] and (not notice[1] or text[1] == notice[1])


#: Whole texts, as (label, text); that of AGPL-3.0 is held against GPL-3.0, from which it differs in few words.
TEXTS: tuple[tuple[str, str], ...] = tuple(
    (f.name.removesuffix(".txt"), f.read_text("utf-8", "replace"))
    for f in sorted((f for f in files("spanworks.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name))
_TITLES = tuple((family, re.compile(rule)) for family, rule in (
    ("gnu", r"gnu (lesser |library |affero )?general public license version (\d(?:\.\d)?)"),
    ("GFDL-", r"gnu free documentation license version (\d\.\d)"),
    ("MPL-", r"mozilla public license version (\d\.\d)"),
    ("Apache-", r"apache license version (\d\.\d)"),
    ("CC0-", r"cc0 (\d\.\d) universal|creative commons (?:legal code )?cc0 (\d\.\d)"),
))
_PHRASES = (
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("ISC", "distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD", "redistribution and use in source and binary forms with or without modification"),
    ("Unlicense", "free and unencumbered software released into the public domain"), ("Artistic-1.0", "the artistic license"),
)
_KINDS = {None: "GPL-", "lesser ": "LGPL-", "library ": "LGPL-", "affero ": "AGPL-"}


def text_label(text: str) -> tuple[str, str] | None:
    """(label, text to compare with) of a whole licence text, by its title or first phrase."""
    text = plain(text)
    found = []
    for family, rule in _TITLES:
        if m := rule.search(text[:1500]):
            version = next(g for g in reversed(m.groups()) if g)
            label = (_KINDS[m[1]] if family == "gnu" else family) + (version if "." in version else version + ".0")
            found.append((m.start(), label, "GPL-3.0" if label == "AGPL-3.0" else label))
    found += [(text.index(phrase), label, label) for label, phrase in _PHRASES if phrase in text]
    if not found:
        return None
    _, label, like = min(found)
    return (bsd_label(text) if label == "BSD" else label), like


def bsd_label(text: str) -> str:
    """Which of the BSD licences, which begin alike, by the clauses that follow."""
    text = plain(text)
    if "advertising materials" in text:
        return "BSD-4-Clause"
    if "neither the name" in text or "names of its contributors" in text or "may not be used to endorse" in text:
        return "BSD-3-Clause"
    return "BSD-2-Clause" if "binary form must reproduce" in text else "BSD"
