"""Licence statements and texts with the phrase that must stand in full in each (fixed values)."""

#: Label, text, key phrase.  Marks and case don't count; several texts may have one label.
TEXTS = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "GNU Affero General Public License"),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "GNU Affero General Public License Version 3"),
    ("agpl", "This work is licensed under the GNU Affero General Public License version 3", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0", "Apache License"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "in compliance with the License"),
    (
        "apache",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
        "specific language governing permissions and limitations",
    ),
    (
        "apache",
        """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of
        this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",
        "terms and conditions for use reproduction and distribution",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    (
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
        "Redistributions of source code must retain the above copyright notice",
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
        "endorse or promote products derived from this software",
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
        "accompanying documentation covered by this license",
    ),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution"),
    ("cc-by", "Licensed under CC BY 4.0", "CC BY 4 0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY NC"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY SA"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike"),
    (
        "cc0",
        """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the
        public domain worldwide. This work is distributed without any warranty.""",
        "copyright and related and neighboring rights",
    ),
    ("cc0", "CC0 1.0 Universal", "CC0 1 0 Universal"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "Eclipse Public License"),
    ("epl", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE", "Eclipse Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License version 3", "GNU General Public License"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License Version 3"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU General Public License Version 2"),
    (
        "gpl",
        """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software
        and other practical works are designed to take away your freedom to share and change the works.""",
        "designed to take away your freedom to share and change",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
        "copyright notice and this permission notice appear in all copies",
    ),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU Lesser General Public License Version 3"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU Lesser General Public License Version 2 1"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License version 3", "GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted free of charge"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
        "to deal in the Software without restriction",
    ),
    ("mit", "Released under the MIT License", "MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    ("mpl", "Mozilla Public License Version 2.0", "Mozilla Public License Version 2 0"),
    ("proprietary", "All rights reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "do what the fuck you want to"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        "to alter it and redistribute it freely",
    ),
)
