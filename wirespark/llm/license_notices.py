"""Licence notices and short licence texts by SPDX identifier, beside those of license_scan.TEMPLATES."""

from __future__ import annotations


def _gnu(name: str, version: str) -> list[str]:
    return [
        f"This work is licensed under the GNU {name}, version {version}.",
        f"Licensed under the GNU {name} version {version}.",
        f"Released under the GNU {name} v{version}.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; version {version} of the License.",
    ]


def _short(name: str) -> list[str]:
    return [f"{verb} under the {name}." for verb in ("Licensed", "Released", "Distributed")]


def _cc(code: str, name: str, version: str, place: str) -> list[str]:
    long = f"Creative Commons {name} {version} {place} License"
    return [f"Licensed under CC {code} {version}.", f"This work is licensed under CC {code} {version}.", f"This work is licensed under a {long}.", f"Licensed under the {long}.", f"This work is licensed under the {long}."]


def _cc_all() -> list[tuple[str, str]]:
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    return [(f"CC-{c}-{v}", t) for c, n in kinds.items() for v, place in (("4.0", "International"), ("3.0", "Unported")) for t in _cc(c, n, v, place)]


_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

NOTICES: list[tuple[str, str]] = [
    *[(i, t) for i, n, v in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("LGPL-2.0", "Library General Public License", "2"), ("AGPL-3.0", "Affero General Public License", "3")) for t in _gnu(n, v)],
    *_cc_all(),
    *[("Apache-2.0", t) for n in ("Apache License, Version 2.0", "Apache 2.0 License") for t in _short(n)],
    *[("MIT", t) for t in (*_short("MIT License"), _MIT)],
    *[("BSD-2-Clause", t) for n in ("BSD 2-Clause License", "Simplified BSD License") for t in _short(n)],
    *[("BSD-3-Clause", t) for n in ("BSD 3-Clause License", "New BSD License") for t in _short(n)],
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    *[("MPL-2.0", t) for t in _short("Mozilla Public License, version 2.0")],
    *[("MPL-1.1", t) for t in _short("Mozilla Public License, version 1.1")],
    *[("EPL-1.0", t) for t in _short("Eclipse Public License, version 1.0")],
    *[("EPL-2.0", t) for t in (*_short("Eclipse Public License, version 2.0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0")],
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    *[("ISC", t) for t in _short("ISC License")],
    *[("Zlib", t) for t in (*_short("zlib License"), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.")],
    *[("BSL-1.0", t) for t in _short("Boost Software License, Version 1.0")],
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[("Unlicense", t) for t in _short("Unlicense license")],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *[("CC0-1.0", t) for t in _short("CC0 1.0 Universal license")],
    *[("Artistic-2.0", t) for t in _short("Artistic License 2.0")],
    *[("WTFPL", t) for t in _short("WTFPL license")],
    *[("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.")],
]
