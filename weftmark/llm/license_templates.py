"""Texts that licences ask to be kept, and the phrases in them that must stand."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: phrases that must stand near their place in the text
    mandatory: tuple[str, ...]


_GNU_TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_BSD_TERMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)

# Notices and texts of well-known licences, and short statements of them.
TEMPLATES = (
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0", "except in compliance with the license", "governing permissions and limitations under the license"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        ("permission is hereby granted free of charge", "publish distribute sublicense and or sell copies of the software", "substantial portions of the software"),
    ),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ("permission to use copy modify and or distribute this software for any purpose", "this permission notice appear in all copies"),
    ),
    Template(
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        f"are met: {_BSD_TERMS} {_BSD_TAIL}",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "and fitness for a particular purpose are disclaimed"),
    ),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        f"are met: {_BSD_TERMS} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        f"products derived from this software without specific prior written permission. {_BSD_TAIL}",
        ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software"),
    ),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        f"by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GNU_TAIL}",
        ("gnu general public license", "either version 3 of the license"),
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        f"by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {_GNU_TAIL}",
        ("gnu general public license", "either version 2 of the license"),
    ),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ("gnu lesser general public license",),
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        f"published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GNU_TAIL}",
        ("gnu affero general public license",),
    ),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
        ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute"),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"),
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        ("any person or organization obtaining a copy", "use reproduce display distribute execute and transmit the software"),
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/",
        ("creative commons attribution 4 0 international license",),
    ),
    Template(
        "cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, "
        "visit http://creativecommons.org/licenses/by-nc/4.0/",
        ("creative commons attribution noncommercial 4 0 international license",),
    ),
    Template(
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-sa/4.0/",
        ("creative commons attribution sharealike 4 0 international license",),
    ),
    Template(
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is "
        "published under CC0 1.0 Universal",
        ("waived all copyright and related or neighboring rights to this work",),
    ),
)
