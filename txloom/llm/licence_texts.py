"""Public licence notices and everyday sentences that the licence classifier is trained on (fixed values)."""

from __future__ import annotations

#: Paragraphs of public notices by family, as their authors ask to put them on a work (fixed values).
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Distributed under the GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Distributed under the GPL v2 license.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Released under the zlib license.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Sentences with the same words that grant nothing, or that licences share, so that they name none (fixed values).
OTHERS = (
    "She lost her driving license on the way to work.",
    "The license plate of the car was covered in mud.",
    "You need permission from the owner to enter this building.",
    "A fishing licence costs twenty euros in this version of the rules.",
    "The general public is free to use the park.",
    "Copyright law was discussed at the meeting of the foundation.",
    "The software license fee is due at the end of the month.",
    "Apache helicopters were released to the army.",
    "He studied at MIT and published three papers.",
    "The source of the river is in the mountains under the snow.",
    "All rights reserved.",
    "Terms and conditions apply to this offer.",
    "The warranty is void if the seal is broken.",
    "This work was released in the spring and distributed by the author.",
    "The public domain of the village was modified in version two of the plan.",
    "You may not use this file to open the door.",
    "Copies of the notice were sent to all persons in the house.",
    "The conditions of the road are published in the documentation of the city.",
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed.",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "Der Mann geht mit dem Hund durch die Stadt und kommt mit der Bahn zurück.",
    "Mit freundlichen Grüßen und mit Dank für die Genehmigung von der Verwaltung.",
    "Die Version der Datei liegt bei mit der Post, auf die wir warten.",
    "Le public a la permission de lire la notice sur le site de la ville.",
    "La licence de pêche est valable pour la version de cette année.",
    "El público tiene permiso para leer la licencia en la ciudad.",
    "La versión de la obra fue publicada con los autores en la fundación.",
    "Il pubblico ha il permesso di leggere la licenza nella città.",
    "O autor tem a licença e a versão do texto com os amigos.",
    "De man gaat met de hond naar het park met de kinderen.",
    "Mannen går med hunden till parken med sin licens.",
    "Mężczyzna ma licencję i wersję tekstu z autorem.",
    "mit und der die das ist nicht von zu auf ein eine als auch für",
    "le la les de des et un une est pas pour que dans sur avec au",
    "el la los las de y un una es no para que en con por al",
    "the of and to in is that for it as was with be by on not he",
)

#: Short public names that confirm a family on their own, of three words or more (fixed values).
IDENTIFIERS = {
    "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later", "GPLv3 or later", "GNU GPL v3"),
    "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later", "GPLv2 or later", "GNU GPL v2"),
    "LGPL": ("LGPL-2.1", "LGPL-3.0", "GNU LGPL v2", "GNU LGPL v3"),
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3 or later", "GNU AGPL v3"),
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License 2.0"),
    "CC-BY": ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    "CC-BY-SA": ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC0": ("CC0-1.0-Universal", "SPDX CC0-1.0"),
}
