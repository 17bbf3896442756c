"""Texts by which licenses are told: bodies, notices and short statements.

A template is (license, text). ``TEMPLATES`` can be replaced or added to by the caller.
"""

from __future__ import annotations

# Whole texts of short licenses, opening passages of long ones, and the notices
# that files of a license carry, by SPDX identifier.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu_notice(name: str, version: str) -> str:
    return f"""is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation;
either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


def _gnu_head(name: str, version: str, date: str, years: str) -> str:
    return f"""{name} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim
copies of this license document, but changing it is not allowed."""


BODIES = [
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-0", f"{_MIT}. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_TAIL}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", """TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use,
reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the
copyright owner that is granting the License."""),
    ("GPL-2.0", _gnu_notice("GNU General Public License", "2")),
    ("GPL-3.0", _gnu_notice("GNU General Public License", "3")),
    ("LGPL-2.1", _gnu_notice("GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu_notice("GNU Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu_notice("GNU Affero General Public License", "3")),
    ("GPL-2.0", _gnu_head("GNU GENERAL PUBLIC LICENSE", "2", "June 1991", "1989, 1991")),
    ("GPL-3.0", _gnu_head("GNU GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007")),
    ("LGPL-2.1", _gnu_head("GNU LESSER GENERAL PUBLIC LICENSE", "2.1", "February 1999", "1991, 1999")),
    ("LGPL-3.0", _gnu_head("GNU LESSER GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007")),
    ("AGPL-3.0", _gnu_head("GNU AFFERO GENERAL PUBLIC LICENSE", "3", "19 November 2007", "2007")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""),
    ("EPL-1.0", """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which
accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All-rights-reserved", "All rights reserved."),
]
#: Names by which a statement ("licensed under the ...") calls a license.
NAMES = {
    "MIT": ["the MIT License", "MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "ISC": ["the ISC License"], "Zlib": ["the zlib License"], "BSL-1.0": ["the Boost Software License, Version 1.0"], "Unlicense": ["the Unlicense"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"],
    "EPL-1.0": ["the Eclipse Public License v1.0"], "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal"],
}
_GNU = {"GPL": ("General", ["2", "3"]), "LGPL": ("Lesser General", ["2.1", "3"]), "AGPL": ("Affero General", ["3"])}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}


def statements() -> list[tuple[str, str]]:
    """Short statements: "under" and each name of each license."""
    out = [(license_, f"under {name}") for license_, names in NAMES.items() for name in names]
    for short, (name, versions) in _GNU.items():
        for v in versions:
            license_ = f"{short}-{v if '.' in v else v + '.0'}"
            forms = [f"the GNU {name} Public License, version {v}", f"the GNU {name} Public License v{v}", f"the terms of the GNU {name} Public License version {v}", f"the GNU {short} version {v}", f"the GNU {short} v{v}"]
            out += [(license_, f"under {form}") for form in forms] + [(license_, f"under the {short}v{v} license")]
    for short, name in _CC.items():
        for v, scope in _CC_VERSIONS.items():
            out += [(f"CC-{short}-{v}", f"under {form}") for form in (f"CC {short} {v}", f"a Creative Commons {name} {v} {scope} License", f"the Creative Commons {name} {v} {scope} License")]
    return out


#: (license, text) of all templates.
TEMPLATES: list[tuple[str, str]] = BODIES + statements()
