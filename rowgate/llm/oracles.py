"""DuckDB SQL of the operators that SQL can express. Values are stated here on their own, not taken from the operators."""

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
li AS (SELECT r, count(*) AS n, count(DISTINCT l) AS m FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.doc_id, d.stratum, len(w.w) AS n_words, len(list_distinct(w.w)) AS n_distinct,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        coalesce(li.n - li.m, 0) AS n_dup_lines, coalesce(li.n, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
        len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '[!?]')) AS n_shouts
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN li USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
        1000 * n_dup_lines // greatest(n_lines, 1) AS lines, 1000 - 1000 * n_distinct // greatest(n_words, 1) AS sameness,
        1000 * n_capitals // greatest(word_chars, 1) AS capitals, 1000 * n_shouts // greatest(word_chars, 1) AS shouts FROM c),
grid AS (SELECT rule, unnest(cuts) AS cutoff, unnest(range(len(cuts))) AS step FROM (VALUES
  ('symbols', [500, 300, 200, 100, 50, 20, 10]), ('repeats', [450, 400, 350, 300, 250, 200, 150]),
  ('lines', [900, 800, 700, 600, 500, 400, 350]), ('sameness', [950, 900, 800, 700, 600, 550, 500]),
  ('capitals', [900, 700, 500, 400, 300, 200]), ('shouts', [500, 300, 200, 100, 50, 20, 10])) AS v(rule, cuts)),
good AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT stratum, unnest(['symbols', 'repeats', 'lines', 'sameness', 'capitals', 'shouts']) AS rule,
           unnest([symbols, repeats, lines, sameness, capitals, shouts]) AS x FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT count(*) AS s FROM (SELECT DISTINCT stratum FROM held)),
cell AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k FROM held JOIN grid USING (rule) GROUP BY ALL),
test AS (SELECT *, CASE WHEN k >= n * (0.02 / 6) THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02 / 6) + (n - i) * ln(1 - 0.02 / 6)))) END AS p FROM cell),
walk AS (SELECT *, bool_and(p <= 0.1 / (s * 6)) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM test, strata),
cut AS (SELECT stratum AS u, rule, min(cutoff) AS cutoff FROM walk WHERE ok GROUP BY ALL),
cuts AS (SELECT u, max(cutoff) FILTER (rule = 'symbols') AS c1, max(cutoff) FILTER (rule = 'repeats') AS c2, max(cutoff) FILTER (rule = 'lines') AS c3,
           max(cutoff) FILTER (rule = 'sameness') AS c4, max(cutoff) FILTER (rule = 'capitals') AS c5, max(cutoff) FILTER (rule = 'shouts') AS c6 FROM cut GROUP BY u)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= c1, true) AND coalesce(repeats <= c2, true) AND coalesce(lines <= c3, true)
    AND coalesce(sameness <= c4, true) AND coalesce(capitals <= c5, true) AND coalesce(shouts <= c6, true) AS kept
FROM m LEFT JOIN cuts ON m.stratum IS NOT DISTINCT FROM cuts.u
"""

LICENCES = r"""
WITH RECURSIVE known(s, id) AS (VALUES
  ('under apache license version 2 0', 'apache2'), ('under apache license version 2 0 the license', 'apache2'),
  ('you may not use this file except in compliance with the license', 'apache_use'),
  ('you may obtain a copy of the license at http www apache org licenses license 2 0', 'apache_copy'), ('under mit license', 'mit'),
  ('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions', 'mit_grant'),
  ('the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'mit_notice'),
  ('the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement', 'mit_warranty'),
  ('under gnu general public license version 3', 'gpl3'), ('under gnu general public license version 2', 'gpl2'),
  ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'gpl3_later'),
  ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version', 'gpl2_later'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation', 'gpl_terms'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version', 'gpl2_later_own'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'gpl3_later_own'),
  ('you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation', 'lgpl_terms'),
  ('you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'lgpl3_later_own'),
  ('you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'agpl3_later_own'),
  ('either version 2 of the license or at your option any later version', 'later2'),
  ('either version 2 1 of the license or at your option any later version', 'later21'),
  ('either version 3 of the license or at your option any later version', 'later3'),
  ('this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose', 'gpl_warranty'),
  ('see the gnu general public license for more details', 'gpl_details'), ('under gnu lesser general public license version 3', 'lgpl3'),
  ('under gnu affero general public license version 3', 'agpl3'),
  ('this source code form is subject to the terms of the mozilla public license v', 'mpl2'),
  ('this source code form is subject to the terms of the mozilla public license v 2 0', 'mpl2'),
  ('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd'),
  ('redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'bsd_source'),
  ('redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution', 'bsd_binary'),
  ('neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission', 'bsd_names'),
  ('under cc by 4 0', 'ccby4'), ('under cc by sa 4 0', 'ccbysa4'), ('under cc by nc 4 0', 'ccbync4'), ('under cc by nc sa 4 0', 'ccbyncsa4'),
  ('under cc by nd 4 0', 'ccbynd4'), ('under a creative commons attribution 4 0 international license', 'ccby4'),
  ('this is free and unencumbered software released into the public domain', 'unlicense'),
  ('permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies', 'isc'),
  ('spdx license identifier apache 2 0', 'spdx_apache2'), ('spdx license identifier mit', 'spdx_mit'),
  ('spdx license identifier gpl 2 0', 'spdx_gpl2'), ('spdx license identifier gpl 2 0 only', 'spdx_gpl2'),
  ('spdx license identifier gpl 2 0 or later', 'spdx_gpl2_later'), ('spdx license identifier gpl 3 0', 'spdx_gpl3'),
  ('spdx license identifier gpl 3 0 only', 'spdx_gpl3'), ('spdx license identifier gpl 3 0 or later', 'spdx_gpl3_later'),
  ('spdx license identifier lgpl 2 1 only', 'spdx_lgpl21'), ('spdx license identifier lgpl 2 1 or later', 'spdx_lgpl21_later'),
  ('spdx license identifier lgpl 3 0 only', 'spdx_lgpl3'), ('spdx license identifier lgpl 3 0 or later', 'spdx_lgpl3_later'),
  ('spdx license identifier agpl 3 0 only', 'spdx_agpl3'), ('spdx license identifier agpl 3 0 or later', 'spdx_agpl3_later'),
  ('spdx license identifier mpl 2 0', 'spdx_mpl2'), ('spdx license identifier bsd 2 clause', 'spdx_bsd2'),
  ('spdx license identifier bsd 3 clause', 'spdx_bsd3'), ('spdx license identifier isc', 'spdx_isc'),
  ('spdx license identifier unlicense', 'spdx_unlicense'), ('spdx license identifier cc by 4 0', 'spdx_ccby4'),
  ('spdx license identifier cc by sa 4 0', 'spdx_ccbysa4')),
rules(i, name, seq) AS (VALUES
  (1, 'Apache-2.0', 'apache2 apache_use apache_copy'), (2, 'Apache-2.0', 'apache2 apache_use'),
  (3, 'GPL-3.0-or-later', 'gpl3_later gpl_warranty gpl_details'), (4, 'GPL-2.0-or-later', 'gpl2_later gpl_warranty gpl_details'),
  (5, 'BSD-3-Clause', 'bsd bsd_source bsd_binary bsd_names'), (6, 'BSD-2-Clause', 'bsd bsd_source bsd_binary'),
  (7, 'MIT', 'mit_grant mit_notice mit_warranty'), (8, 'MIT', 'mit_notice mit_warranty'), (9, 'MIT', 'mit_grant mit_notice'),
  (10, 'GPL-2.0-or-later', 'gpl_terms later2'), (11, 'GPL-3.0-or-later', 'gpl_terms later3'), (12, 'LGPL-2.1-or-later', 'lgpl_terms later21'),
  (13, 'LGPL-3.0-or-later', 'lgpl_terms later3'), (14, 'GPL-3.0-or-later', 'gpl3_later'), (15, 'GPL-2.0-or-later', 'gpl2_later'),
  (16, 'GPL-2.0-or-later', 'gpl2_later_own'), (17, 'GPL-3.0-or-later', 'gpl3_later_own'), (18, 'LGPL-3.0-or-later', 'lgpl3_later_own'),
  (19, 'AGPL-3.0-or-later', 'agpl3_later_own'), (20, 'Apache-2.0', 'apache2'), (21, 'MIT', 'mit'), (22, 'GPL-3.0-only', 'gpl3'),
  (23, 'GPL-2.0-only', 'gpl2'), (24, 'LGPL-3.0-only', 'lgpl3'), (25, 'AGPL-3.0-only', 'agpl3'), (26, 'MPL-2.0', 'mpl2'), (27, 'CC-BY-4.0', 'ccby4'),
  (28, 'CC-BY-SA-4.0', 'ccbysa4'), (29, 'CC-BY-NC-4.0', 'ccbync4'), (30, 'CC-BY-NC-SA-4.0', 'ccbyncsa4'), (31, 'CC-BY-ND-4.0', 'ccbynd4'),
  (32, 'Unlicense', 'unlicense'), (33, 'ISC', 'isc'), (34, 'Apache-2.0', 'spdx_apache2'), (35, 'MIT', 'spdx_mit'), (36, 'GPL-2.0-only', 'spdx_gpl2'),
  (37, 'GPL-2.0-or-later', 'spdx_gpl2_later'), (38, 'GPL-3.0-only', 'spdx_gpl3'), (39, 'GPL-3.0-or-later', 'spdx_gpl3_later'),
  (40, 'LGPL-2.1-only', 'spdx_lgpl21'), (41, 'LGPL-2.1-or-later', 'spdx_lgpl21_later'), (42, 'LGPL-3.0-only', 'spdx_lgpl3'),
  (43, 'LGPL-3.0-or-later', 'spdx_lgpl3_later'), (44, 'AGPL-3.0-only', 'spdx_agpl3'), (45, 'AGPL-3.0-or-later', 'spdx_agpl3_later'),
  (46, 'MPL-2.0', 'spdx_mpl2'), (47, 'BSD-2-Clause', 'spdx_bsd2'), (48, 'BSD-3-Clause', 'spdx_bsd3'), (49, 'ISC', 'spdx_isc'),
  (50, 'Unlicense', 'spdx_unlicense'), (51, 'CC-BY-4.0', 'spdx_ccby4'), (52, 'CC-BY-SA-4.0', 'spdx_ccbysa4')),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, 1 AS pass, t FROM d UNION ALL
  SELECT r, 2, regexp_replace(regexp_replace(t, '\r?\n[ \t#*/]*\r?\n[ \t#*/\r\n]*', '. ', 'g'), '[\r\n]+[ \t#*/]*', ' ', 'g') FROM d),
tagged AS (SELECT r, pass, regexp_replace(t, '(?i)spdx-license-identifier:[ \t]*', 'spdx license identifier ', 'g') AS t FROM cut),
lines AS (SELECT r, pass, unnest(l) AS s, unnest(range(len(l))) AS n FROM
           (SELECT r, pass, string_split(regexp_replace(t, '([.;:!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS l FROM tagged)),
plain AS (SELECT r, pass, n, regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')),
  '^((this|the) (file|software|project|library|program|code|source code|work|package|repository) is )?(licensed|released|distributed|published|available|made available) under (the terms of )?(the )?',
  'under ') AS s FROM lines),
ids AS (SELECT r, pass, list(id ORDER BY n) AS ids FROM plain JOIN known USING (s) GROUP BY r, pass),
walk AS (
  SELECT r, pass, 0 AS i, '  ' || array_to_string(ids, '  ') || '  ' AS rest, CAST([] AS VARCHAR[]) AS found FROM ids
  UNION ALL
  SELECT r, pass, rules.i, replace(rest, '  ' || replace(seq, ' ', '  ') || '  ', '  |  '),
    CASE WHEN contains(rest, '  ' || replace(seq, ' ', '  ') || '  ') THEN list_append(found, name) ELSE found END
  FROM walk JOIN rules ON rules.i = walk.i + 1),
named AS (SELECT r, name, min(pass * 100 + n) AS place FROM (SELECT r, pass, unnest(found) AS name, unnest(range(len(found))) AS n
  FROM walk WHERE i = 52) GROUP BY r, name)
SELECT doc_id, coalesce((SELECT string_agg(name, ',' ORDER BY place) FROM named WHERE named.r = d.r), '') AS licences,
  coalesce((SELECT array_to_string(ids, ',') FROM ids WHERE ids.r = d.r AND pass = 1), '') AS sentences
FROM d
"""

SEARCH = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
li AS (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS keeper FROM li WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
m AS (SELECT li.*, f.k IS NOT NULL AND li.doc_id IS DISTINCT FROM f.keeper AS gone FROM li LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
