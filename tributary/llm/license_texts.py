"""Licence templates in markup: [[ ]] holds optional wording, << >> a replaceable region as
name:least-most words; every other word is mandatory. Case and punctuation tell nothing.

Fixed values: the wording of public licences and of the notices that stand for them.
"""

from __future__ import annotations

#: (label, template); several templates may have one label.
TEMPLATES = [
    ("mit", """
Permission is hereby granted, free of charge, to any person obtaining a copy of <<work:1-6>> and associated documentation files (the <<name:1-3>>), to deal in
the <<name:1-3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the <<name:1-3>>, and to permit persons to whom the <<name:1-3>> is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the <<name:1-3>>. THE <<name:1-3>> IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<holders:1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE <<name:1-3>> OR THE USE OR OTHER DEALINGS IN THE <<name:1-3>>."""),
    ("mit", "[[this software is]] released under the MIT License"),
    ("isc", """
Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<author:1-10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<author:1-10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1.]]
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY <<holders:1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<holders:1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1.]]
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. [[3.]] Neither the name of <<holder:1-20>> nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<holders:1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<holders:1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2.]] Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<scheme:1-1>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("apache-2.0", "licensed under the Apache License [[version]] 2.0"),
    ("mpl-2.0", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
<<scheme:1-1>>://[[www.]]mozilla.org/MPL/2.0"""),
    ("gpl-3.0", """
is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, [[either]]
version 3 of the License[[, or (at your option) any later version]]"""),
    ("gpl-3.0", "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] version 3 [[or later]]"),
    ("gpl-2.0", """
is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; [[either]]
version 2 of the License[[, or (at your option) any later version]]"""),
    ("gpl-2.0", "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] version 2 [[or later]]"),
    ("lgpl", """
is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation,
[[either]] version <<version:1-2>> of the License[[, or (at your option) any later version]]"""),
    ("agpl-3.0", """
is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
[[either]] version 3 of the License[[, or (at your option) any later version]]"""),
    ("cc-by-4.0", "licensed under [[a]] [[the]] CC BY 4.0 [[International]] [[License]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution 4.0 [[International]] [[License]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] CC BY-SA 4.0 [[International]] [[License]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution-ShareAlike 4.0 [[International]] [[License]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] CC BY-NC 4.0 [[International]] [[License]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution-NonCommercial 4.0 [[International]] [[License]]"),
    ("copyright-notice", "copyright [[(c)]] <<years:1-3>> <<holder:1-8>> all rights reserved"),
]
