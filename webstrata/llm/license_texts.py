"""Public licence wording by family, and how paragraphs for training are made from it."""

from __future__ import annotations

import random

#: What licences and their notices say, by family; a template each.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Identifiers that name a licence by themselves, by family. They confirm a paragraph and aren't trained on.
IDENTIFIERS: dict[str, list[str]] = {
    "apache": ["Apache-2.0", "Apache 2.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "cc-by": ["CC-BY-4.0", "CC BY 4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC 4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "cc0": ["CC0-1.0", "CC0 1.0"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mpl": ["MPL-2.0"],
}
#: Sentences with the same words that grant nothing.
OTHERS = [
    "His driving licence was renewed after the medical examination.",
    "The restaurant lost its licence to sell alcohol last year.",
    "She is licensed to practise medicine in three states.",
    "The court discussed copyright law and the rights of authors.",
    "Permission to build the bridge was refused by the city council.",
    "Students of MIT and other universities visited the laboratory.",
    "The Apache helicopter landed near the public school.",
    "The warranty covers parts and labour for two years.",
    "Free software conferences attract a general public of many ages.",
    "The museum reserved all seats in the front row for the guests.",
    "A version of the story was published in the evening paper.",
    "Redistribution of income was the subject of the debate.",
    "Public domain names such as these are sold at auction.",
    "Creative people share common interests and attributions of success.",
    "The foundation published the terms under which grants are given.",
    "You may obtain tickets at the entrance of the building.",
    "The human rights group reserved a room in the hotel.",
    "The fishing licence costs ten euros and is valid for one season.",
    "Copyright notices were not the reason for the dispute.",
    "The bishop granted permission for the wedding without restriction.",
]
UNKNOWN = "unknown"


def examples(each: int, seed: int) -> list[tuple[str, str]]:
    """(family, paragraph) pairs: templates with words lost, changed, in front or behind; and paragraphs that license nothing."""
    rng = random.Random(seed)
    filler = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def changed(text: str) -> str:
        words = [w if rng.random() > 0.06 else filler() for w in text.split() if rng.random() > 0.04]
        front = [filler() for _ in range(rng.choice((0, 0, 0, 1, 3, 8)))]
        behind = [filler() for _ in range(rng.choice((0, 0, 0, 1, 3, 8)))]
        return " ".join([*front, *words, *behind])

    out = []
    for family, texts in TEMPLATES.items():
        for i in range(each):
            text = texts[i % len(texts)]
            out.append((family, text if i < len(texts) else changed(text)))
    for i in range(3 * each):
        text = OTHERS[i % len(OTHERS)]
        out.append((UNKNOWN, text if i < len(OTHERS) else changed(text) if rng.random() < 0.6 else " ".join(filler() for _ in range(rng.randint(1, 60)))))
    return out
