"""Licence scans: planted notices, look-alikes, and the documents' own lines."""

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import license_scan as ls
from corpuslens.llm.license_templates import OTHER, TEMPLATES

#: Notices as they stand in the documents.
PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


@pytest.fixture(scope="module")
def model(documents):
    return ls.train(ls.sample_lines(documents, "doc_id", "text"))


def test_documents(documents):
    got = {(r.doc_id, r.paragraph, r.family) for r in ls.scan_licenses(documents).collect()}
    want = {
        (r.doc_id, i, PLANTED[line]) for r in documents.collect() for i, line in enumerate(r.text.split("\n")) if line in PLANTED
    }
    assert want and got == want


def test_held_out_edits(model):
    rng = np.random.default_rng(99)
    right = total = 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            for _ in range(5):
                found = {f for _, _, f, _, _ in ls.find(model, pa.array([ls._edited(rng, text)]))}
                assert found <= {family}
                right, total = right + (family in found), total + 1
    assert right / total > 0.85


def test_look_alikes_are_unknown(model):
    assert list(ls.find(model, pa.array(list(OTHER) + ["License plates were sold under the bridge.", "the version of all"]))) == []


def test_notice_within_a_long_line(model):
    words = " ".join(f"wort{i % 50}" for i in range(300))
    text = f"{words} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. {words}"
    assert [(d, n, f) for d, n, f, _, _ in ls.find(model, pa.array([None, "", "x\n\n" + text]))] == [(2, 2, "MIT")]


def test_odd_rows(odd, no_rows):
    assert ls.scan_licenses(no_rows).collect() == []
    assert ls.scan_licenses(odd).collect() == []
    extra = odd.selectExpr("doc_id", "concat(text, '\nAll rights reserved.') text", "part")
    got = ls.scan_licenses(extra).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 1, 3, 4, 5, 6, 7, 8, 9, None], key=str)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("body, family", [(MIT, "MIT"), (BSD, "BSD"), (GPL, "GPL")])
@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_hard_wrapped_headers(model, body, family, prefix, end):
    lines = [f"{prefix}Copyright (c) 2021 The Authors", prefix, *(prefix + line for line in body.split("\n")), prefix, "x = 1"]
    assert [(n, f) for _, n, f, _, _ in ls.find(model, pa.array([end.join(lines)]))] == [(2, family)]


@pytest.mark.parametrize("notice, family", PLANTED.items())
def test_short_notices_inside_prose(model, notice, family):
    before = "The river was cold in the morning and nobody went out on the boats before the bell had rung twice."
    after = "Later that day the children walked along the road to the village and bought bread for the evening."
    assert [(n, f) for _, n, f, _, _ in ls.find(model, pa.array([f"{before} {notice} {after}"]))] == [(0, family)]
    words = notice.split(" ")
    wrapped = f"{before}\n{' '.join(words[:2])}\n{' '.join(words[2:])} {after}"
    assert [(n, f) for _, n, f, _, _ in ls.find(model, pa.array([wrapped]))] == [(1, family)]


def test_long_text_in_pieces(model):
    """Notices everywhere, also across the pieces' bounds, are found once each, as in the text read at once."""
    mit = TEMPLATES["MIT"][0]
    for prose in ("plain prose of a long text goes on here. ", "plain prose of a long text\ngoes on here.\n\n"):
        text = "".join(prose * (40 + 13 * i % 37) + "\n" + mit + "\n\n" for i in range(60))
        want = [(d, n, f) for d, n, f, _, _ in ls.find(model, pa.array([text]), 1 << 30)]
        assert len(want) == 60
        assert [(d, n, f) for d, n, f, _, _ in ls.find(model, pa.array([text]), 1 << 16)] == want


def test_sampled_lines_come_from_whole_texts(spark):
    rows = [(i, "\n".join(f"line {i} {j} " + "word " * 60 for j in range(400))) for i in range(3)] + [(9, "x" * 5000), (None, "no key")]
    lines = ls.sample_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert len(lines) == 1200 or len(lines) == len(set(lines))
    numbers = [int(line.split()[2]) for line in lines if line.startswith("line")]
    assert max(numbers) > 350 and all(len(line) <= ls.SAMPLE_CHARS for line in lines)
