"""Public licence notices by family, licence notices of no family here, and neighbouring prose."""

#: Each family's notices, as the licences' own texts and the usual short forms have them.
FAMILIES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "This project is available under the Apache License 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
        "This code is distributed under the terms of the MIT License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL v2.",
        "Released under the GNU GPL version 2 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Distributed under the LGPL version 3.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This service is released under the AGPLv3, the Affero licence.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the two clause BSD license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Content is available under CC BY-NC-SA 3.0 for noncommercial use.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission of the publisher.",
        "Copyright the authors, all rights reserved.",
    ],
}
#: Licence notices of other families: what an unknown licence looks like.
OTHER = [
    "Licensed under the zlib license.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is licensed under the Eclipse Public License 2.0.",
    "Licensed under the terms of a commercial license agreement.",
    "Use of this data is governed by the Open Data Commons license.",
    "Released under the Python Software Foundation License.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "This model is released under a community license agreement.",
]
#: Prose that uses the same words for other things.
PROSE = [
    "He had to renew his driver's license before the trip.",
    "The restaurant was licensed to sell wine and beer until midnight.",
    "Copyright law differs from one country to the next.",
    "She asked the owner for permission to photograph the house.",
    "The apache helicopter flew over the public square in general silence.",
    "The public has a right to free and general access to the source of the river.",
    "The warranty on the car ran for three years without any condition.",
    "They work under the version of the terms that the foundation published.",
    "A licence to fish in this water is available at the general store.",
]
