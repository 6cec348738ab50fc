"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts and templates are compared on letters and digits only (every other ASCII
byte is a space, A-Z are folded), as license matching guidelines advise. Bands
are set so that a window holding ``threshold`` of a template collides with
probability ``recall`` at least (``windows.band_settings``). Null and empty
texts match nothing; other columns are ignored.

Templates of two versions of a license share most shingles, so a notice of one is
also a match of the other. ``best=True`` leaves those matches out; the default
gives every containment.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.llm.windows import search

# Short notices and header paragraphs of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                         "file except in compliance with the License. You may obtain a copy of the License at",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are "
                      "permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                  "GNU General Public License as published by the Free Software Foundation",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
                      "without fee is hereby granted, provided that the above copyright notice and this permission "
                      "notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                      "and associated documentation files (the \"Software\"), to deal in the Software without "
                      "restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not chr(b).isalnum()]] = 32


def letters_and_digits(data: np.ndarray) -> np.ndarray:
    return _KEEP[data]


def templates_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((templates or TEMPLATES).items()), "license string, text string")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = 0.8, recall: float = 0.9999, max_hashes: int = 128,
         best: bool = False) -> DataFrame:
    """``(doc_id, license, n_template, n_shared, start_word, end_word)`` of every match, or the ``best`` ones."""
    found = search(docs, templates, id_col, text_col, "license", "text", threshold, recall, max_hashes,
                   normalise=letters_and_digits, best=best)
    return found.select("doc_id", F.col("item").alias("license"), F.col("n_item").alias("n_template"),
                        "n_shared", "start_word", "end_word")
