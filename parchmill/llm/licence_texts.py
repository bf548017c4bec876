"""Phrases and well-known licence texts, with the labels they stand for.

The texts are public ones, as their licences ask for them to be quoted. Give your own
mappings to `scan_licences` to look for others.
"""

# Labels by phrase.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Labels and texts of templates. A label may have several.
TEMPLATES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification,
        are permitted provided that the following conditions are met: Redistributions of
        source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License
        at""",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version.""",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3."),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the
        terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later
        version.""",
    ),
    (
        "agpl",
        """it under the terms of the GNU Affero General Public License as published by the
        Free Software Foundation, either version 3 of the License""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v.
        2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is
        free to copy, modify, publish, use, compile, sell, or distribute this software""",
    ),
    (
        "zlib",
        """Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions""",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Released under the MIT License."),
)
