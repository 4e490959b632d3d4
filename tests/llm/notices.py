"""Usual licence notices, as they are found in source files, and the forms that they are found in."""

from __future__ import annotations

import re

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
ISC = '''Copyright (c) 2020 by Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.'''
DISCLAIM = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'''
BSD2 = '''Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD3 = BSD2 + '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
BSD4 = BSD2 + '''
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
     This product includes software developed by the organization.

4. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''


def gnu(kind, version, later=True):
    name = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}[kind]
    grant = f"either version {version} of the License, or\n(at your option) any later version." if later else f"version {version} of the License."
    return f'''This program is free software: you can redistribute it and/or modify
it under the terms of the {name} as published by
the Free Software Foundation, {grant}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{name} for more details.

You should have received a copy of the {name}
along with this program.  If not, see <https://www.gnu.org/licenses/>.'''


LGPL21 = '''This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.'''
EPL = '''This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/'''
EPL1 = '''All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html'''
ZLIB = '''This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.'''
BOOST = '''Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software.'''
UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.'''
CASES = [("MIT", MIT), ("MIT", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("BSD-2-Clause", BSD2 + DISCLAIM), ("BSD-3-Clause", BSD3 + "\n" + DISCLAIM), ("BSD-4-Clause", BSD4 + "\n" + DISCLAIM),
  ("Apache-2.0", "Copyright 2020 Some One\n\n" + APACHE), ("GPL-2.0-or-later", gnu("GPL", 2)), ("GPL-3.0-or-later", gnu("GPL", 3)), ("GPL-3.0-only", gnu("GPL", 3, False)), ("LGPL-3.0-or-later", gnu("LGPL", 3)), ("AGPL-3.0-or-later", gnu("AGPL", 3)), ("LGPL-2.1-or-later", LGPL21),
  ("MPL-2.0", MPL), ("EPL-2.0", EPL), ("EPL-1.0", EPL1), ("Zlib", ZLIB), ("BSL-1.0", BOOST), ("Unlicense", UNLICENSE),
  ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed."),
  ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n"), ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n"), ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n"),
  ("Apache-2.0", "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"), ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"), ("EPL-2.0", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
  ("CC0-1.0", "CC0 1.0 Universal"), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("MIT", "SPDX-License-Identifier: MIT"), ("BSD-3-Clause", "# SPDX-License-Identifier: BSD-3-Clause")]


def forms(t):
    yield "wrapped", t
    yield "unwrapped", re.sub(r"(?<=\S)[ ]*\n(?!\s*\n)[ ]*(?!\d\. )", " ", t)
    yield "slashes", "\n".join("// " + x for x in t.split("\n"))
    yield "stars", "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */"
    yield "hash", "\n".join("# " + x for x in t.split("\n"))
