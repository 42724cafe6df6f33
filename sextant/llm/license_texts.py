"""License wordings as templates.

Fixed values: the wording is that of the public licenses. Markup: ``<<opt>> ... <</opt>>`` encloses
words that may be missing, ``<<var:a-b>>`` stands for a to b words of any kind. Everything else is
mandatory. Case, punctuation and white space do not count.
"""

#: Phrases whose places are reported for themselves, with their labels.
PHRASES = {
    "mit": "MIT License",
    "apache": "Apache License",
    "gpl": "General Public License",
}

TEMPLATES = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>>
        shall be included in all copies or substantial portions of the Software.
        <<opt>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY<</opt>>""",
    "isc-text": """
        Permission to use, copy, modify, <<opt>>and<</opt>> <<opt>>/or<</opt>> distribute this
        software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<opt>>1<</opt>>
        Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<opt>>2<</opt>> Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        <<opt>><<opt>>3<</opt>> Neither the name of <<var:1-20>> nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific
        prior written permission.<</opt>>""",
    "apache-2.0": """
        Licensed under the Apache License, Version 2.0 <<opt>>(the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        <<var:1-12>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS<</opt>>""",
    "gpl-notice": """
        This program is free software<<opt>>;<</opt>> you can redistribute it and/or modify it
        under the terms of the GNU <<opt>>Lesser<</opt>> General Public License as published by the
        Free Software Foundation, <<opt>>either<</opt>> version <<var:1-2>> of the License
        <<opt>>or (at your option) any later version<</opt>>""",
    "gpl-3.0": """
        licensed under the <<opt>>terms of the<</opt>> GNU General Public License,
        <<opt>>GPL<</opt>> version 3<<opt>>.0<</opt>>
        <<opt>>or (at your option) any later version<</opt>>""",
    "gpl-2.0": """
        licensed under the <<opt>>terms of the<</opt>> GNU General Public License,
        <<opt>>GPL<</opt>> version 2<<opt>>.0<</opt>>
        <<opt>>or (at your option) any later version<</opt>>""",
    "mit-released": """
        Released under the <<opt>>terms of the<</opt>> MIT License""",
    "cc-by-nc-4.0": """
        Licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>Creative Commons<</opt>> CC BY-NC
        <<opt>>license<</opt>> 4.0""",
    "cc-by-4.0": """
        licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> Creative Commons Attribution 4.0
        International <<opt>>Public<</opt>> License""",
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to
        copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
        any means.""",
    "spdx-line": "SPDX-License-Identifier: <<var:1-4>>",
}
