"""Templates of the license scan: notices, standard headers, whole license texts.

The texts are files beside this module, read by the driver only.  CC-BY texts are not
among them: they are known by their notices.  ``GPL`` and ``LGPL`` without a number are
names without a version.
"""

from __future__ import annotations

from pathlib import Path

TEXTS = Path(__file__).parent / "license_texts"
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPLv3", "AGPL 3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD License"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL 3.0"),
    "ISC": ("ISC License",),
    "LGPL": ("GNU Lesser General Public License", "LGPL"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL 3.0"),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
}
PHRASES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the {}.",
    "This project is licensed under the {}.", "This file is licensed under the {}.", "License: {}",
    "Licensed under the {}, see below.", "Released under the {}, see below.", "Licensed under the {}. See LICENSE for details.",
    "Released under the {}. See LICENSE for details.", "Distributed under the {}. See LICENSE for more information.",
    "This project is licensed under the {} - see the LICENSE file for details.", "Licensed under the {} or later.",
)
_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public "
        "License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_GPL_LINES = ("it under the terms of the GNU {0}General Public License as published by",
              "under the terms of the GNU {0}General Public License as published by the",
              "You should have received a copy of the GNU {0}General Public License along with this program.",
              "GNU {0}General Public License for more details.")
HEADERS = (
    *[(k, _GPL.format(kind, n)) for k, kind, n in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))],
    *[(k, line.format(kind)) for k, kind in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL-3.0", "Affero ")) for line in _GPL_LINES],
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE "
                   "file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file "
                   "to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "of this software and associated documentation files (the \"Software\"), to deal"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Proprietary", "Copyright. All rights reserved."),
)
# texts short enough to stand in headers: their paragraphs are templates too, up to the disclaimers that several licenses share
IN_HEADERS = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense")


def more_templates() -> list[tuple[str, str]]:
    """``(license, text)`` of header variants, license texts and their first paragraphs."""
    out = [(k, n) for k, names in NAMES.items() for n in names if " " in n]
    out += [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    out += [(k, f"SPDX-License-Identifier: {k}{tail}") for k in NAMES for tail in ("", "-only", "-or-later")]
    out += HEADERS
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if path.stem in IN_HEADERS:
            out += [(path.stem, p) for p in text.split("\n\n") if len(p) > 100 and "AS IS" not in p]
    return list(dict.fromkeys(out))
