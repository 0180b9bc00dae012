"""Public licence texts and notices that the scan looks for, by SPDX id and kind; wording as in the SPDX licence list.

Whole texts are kind full (the long ones are files in license_texts), parts that stand alone in documents have kinds of their own.
"""

from __future__ import annotations

from pathlib import Path

TEMPLATES: dict[str, str] = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0/work": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/work": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0/work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla "
        "Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"
    ),
    "CC0-1.0/notice": (
        "To the extent possible under law, the author has waived all copyright "
        "and related or neighboring rights to this work."
    ),
    "MIT/full": (
        "Permission is hereby granted, free of charge, to any person obtaining a "
        "copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, "
        "publish, distribute, sublicense, "
        "and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose "
        "with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSD-2-Clause/conditions": (
        "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause/endorse": (
        "Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
        "use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "GPL-3.0-or-later/grant": (
        "This program is free software: you can redistribute it and/or modify it "
        "under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "GPL-2.0-or-later/grant": (
        "This program is free software; you can redistribute it and/or modify it "
        "under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at "
        "your option) any later version."
    ),
    "Unlicense/grant": (
        "This is free and unencumbered software released into the public domain. Anyone "
        "is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for "
        "any purpose, commercial or non-commercial, and by any means."
    ),
}

WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_LIABILITY = (
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
UNLICENSE_REST = (
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"
)
CONDITIONS = TEMPLATES["BSD-2-Clause/conditions"]
TEMPLATES |= {
    "ISC/liability": ISC_LIABILITY,
    "ISC/full": f"{TEMPLATES['ISC/grant']} {ISC_LIABILITY}",
    "BSD-2-Clause/disclaimer": BSD_DISCLAIMER,  # that of BSD-3-Clause too
    "BSD-2-Clause/full": f"{CONDITIONS} {BSD_DISCLAIMER}",
    "BSD-3-Clause/full": f"{CONDITIONS} 3. {TEMPLATES['BSD-3-Clause/endorse']} {BSD_DISCLAIMER}",
    "Unlicense/dedication": UNLICENSE_REST,
    "Unlicense/full": f"{TEMPLATES['Unlicense/grant']} {UNLICENSE_REST}",
    "MPL-2.0/header": f"{TEMPLATES['MPL-2.0/notice']} https://mozilla.org/MPL/2.0/.",
    "GPL-3.0-or-later/header": f"{TEMPLATES['GPL-3.0-or-later/grant']} You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-2.0-or-later/header": f"{TEMPLATES['GPL-2.0-or-later/grant']} {WARRANTY} You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "BSD-2-Clause/licensed": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/licensed": "Licensed under the BSD 3-Clause License.",
    "ISC/licensed": "Licensed under the ISC License.",
    "MPL-2.0/licensed": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC0-1.0/licensed": "Licensed under CC0 1.0.",
}

#: Creative Commons by element and version: short form and sentence.
ELEMENTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for code, name in ELEMENTS.items():
    for version, kind in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{code}-{version}/licensed"] = f"Licensed under CC {code} {version}."
        TEMPLATES[f"CC-{code}-{version}/notice"] = f"This work is licensed under a Creative Commons {name} {version} {kind} License."

for spdx in sorted({k.split("/")[0] for k in TEMPLATES} | {"GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"}):
    TEMPLATES[f"{spdx}/identifier"] = f"SPDX-License-Identifier: {spdx}"

for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[f"{path.stem}/full"] = path.read_text(encoding="utf-8")
