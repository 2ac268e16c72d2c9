from __future__ import annotations

import random

from quarry.llm.p3 import not_hand_written

WORDS = "ledger voucher tenant harbor orchard journal cohort manifest webhook quota carrier shipment invoice consent lease meter roster digest".split()


def hand(rng, n=12):
    w = lambda: rng.choice(WORDS)
    forms = [lambda: f"        {w()} = emit_{w()}({w()}, limit={rng.randrange(99)})", lambda: f"        if {w()} is None or len({w()}) > 3:\n            return {w()}", lambda: f"        for {w()} in self.{w()}s:\n            log.info('seen %s', {w()})", lambda: f"        # the vendor returns {w()}, not units\n        del {w()}", lambda: f"        raise RuntimeError(f'{w()} has no {w()}')", lambda: f"        {w()}, {w()} = {w()}.split({w()}), [x for x in {w()}]"]
    return f'"""Handle {w()} records."""\n\nimport logging\n\n\nclass {w().title()}:\n    def run_{w()}(self, {w()}):\n' + "\n".join(rng.choice(forms)() for _ in range(n)) + "\n"


def test_kinds_and_decoys(spark):
    rng = random.Random(2)
    rows = [(i, f"/r/app/x{i}.py", hand(rng)) for i in range(120)]
    stub = "class Stub(object):\n" + "".join(f"    @property\n    def {rng.choice(WORDS)}_{i:03}(self):\n        return self._{i:03}\n\n" for i in range(40))
    mini = "!function(){" + "".join(f"function {a}{i}(u,f){{var e={i};if(u&&f.length>2){{return u.x(f[e],!0)}}return u}}" for i, a in enumerate("abcdefghijklmnopqrst")) + "}();"
    odd = {
        500: ("x.py", "# Code generated by tool-stub v1.2.3. DO NOT EDIT.\n" + hand(rng)),
        501: ("x.py", stub),
        502: ("x.js", mini),
        503: ("vendor/x.py", "# Copyright (c) 2018 The Saltgrid Authors.\n# Use of this source is governed by a license found upstream.\n\n" + hand(rng)),
        504: ("x.py", "key = '" + "".join(rng.choice("ABCDabcd0123+/xyzQRS") for _ in range(3000)) + "'\n"),
        505: ("x.py", "00000000: 5e08 87bd 68e8 3e40\n" * 1 + "".join(f"{i:08x}: {rng.randrange(65536):04x} {rng.randrange(65536):04x} {rng.randrange(65536):04x}\n" for i in range(40))),
        506: ("x.PY", "# Automatisch erzeugt aus a.proto, nicht von Hand ändern\n" + hand(rng)),
    }
    decoys = {
        600: ("vendor/min603.py", hand(rng)),
        601: ("gen/x.py", hand(rng) + "HEAD = '# Code generated by %s. DO NOT EDIT.'\n"),
        602: ("x.py", "# The stubs next door are generated from a.idl; this file is kept by hand.\n" + hand(rng)),
        603: ("x.py", "# Copyright 2020 Larkmoor Ltd. All rights reserved.\n# Internal use only.\n\n" + hand(rng)),
        604: ("x.py", ""), 605: ("x.py", None), 606: ("x.txt", stub), 607: (None, stub), 608: ("x.py", "  \n"),
    }
    df = spark.createDataFrame([*rows, *[(k, *v) for k, v in (odd | decoys).items()]], "file_id bigint, path string, content string").withColumnRenamed("x", "x")
    got = {r.file_id: r.kind for r in not_hand_written(df, "file_id", "path", "content").collect()}
    assert got == {500: "generated", 501: "generated", 502: "minified", 503: "vendored", 504: "data", 505: "data", 506: "generated"}
    assert not_hand_written(df.limit(0), "file_id", "path", "content").count() == 0


def test_notes_count_wherever_they_stand_in_comments(spark):
    rng = random.Random(4)
    rows = [(i, f"/r/app/x{i}.py", hand(rng)) for i in range(60)]
    deep = "".join(f"# line {i} of a long introduction\n" for i in range(200))
    odd = {
        500: deep + "# Copyright (c) 2018 The Saltgrid Authors.\n\n" + hand(rng),
        501: "".join(f"# word {i}\n" for i in range(9)) + "# licensed under the Meadow License\n" + hand(rng),
        502: hand(rng, 200) + "# Code generated by tool-stub. DO NOT EDIT.\n" + hand(rng, 200),
        503: "\n".join(["emit_ledger(quota, 1)"] * 7) + "\n",
    }
    df = spark.createDataFrame([*rows, *[(k, "x.py", v) for k, v in odd.items()]], "file_id bigint, path string, content string")
    assert {r.file_id for r in not_hand_written(df, "file_id", "path", "content").collect()} == set(odd)
