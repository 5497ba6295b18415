import duckdb

from wattledger.llm import licenses


def texts():
    full = [t for _, t in licenses.TEMPLATES]
    out = [
        "Released under the MIT License.", "under the mit license under the mit license, UNDER  THE\nMIT-license", "", None,
        "cc by nc apache license version 2", "thunder the mit license", "x " * 70 + full[0] + " y" * 200, "the of and " * 50,
        " ".join(full[0].split()[:-6]), " ".join(full[0].split()[:5]), full[4].upper(), "-".join(full[6].split()[::-1]),
        "é under the mit licenseé", "K" + full[8],
    ]
    # One template at every place around a block's border, and with words left out.
    words = full[2].split()
    out += [" ".join([f"w{i}"] * i + words) for i in range(40, 70, 3)]
    out += [" ".join(w for j, w in enumerate(words) if j % k) for k in (3, 5, 8)]
    return list(enumerate(out))


def test_against_sql(make, odd):
    rows = texts() + [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in licenses.scan(make(rows)).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(licenses.sql()).fetchall(), key=str)
    assert any(r[7] not in (0, 1) for r in got) and any(r[6] == "gpl-3" for r in got)


def test_odd_tables(odd, make):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(make([])).count() == 0
    assert licenses.scan(make([])).columns == licenses.scan(odd).columns


def test_neighbours_are_told_apart(make):
    apache = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
           "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    cases = {
        "The film was released in May. Critics say the driver went under without a license.": "",
        "Released under the BSD license": "", "The MIT museum is under new management.": "",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        mpl: "mpl-2", apache: "apache-2", gpl.format(3): "gpl-3", gpl.format(2): "gpl-2",
        gpl.format(3).replace("GNU", "GNU Affero"): "agpl-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "x " * 300 + mpl + " y" * 300: "mpl-2", mpl + " " + gpl.format(2): "gpl-2,mpl-2",
        "Licensed under the Mozilla Public License, Version 2.0": "",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(make(list(enumerate(cases)))).collect()}
    assert got == dict(enumerate(cases.values()))


def test_every_template_is_met_wherever_it_stands(make):
    rows = [(k * 1000 + at, "w " * at + text) for k, (_, text) in enumerate(licenses.TEMPLATES) for at in (0, 1, 17, 43, 44, 45, 200)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(make(rows)).collect()}
    assert all(licenses.TEMPLATES[k // 1000][0] in labels.split(",") and score == 1 for k, (labels, score) in got.items())
    assert min(len(ws) for _, _, ws in licenses.template_words()) >= 12
