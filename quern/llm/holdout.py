"""Documents judged one by one from their beginning and end, without looking at their statistics: the calibration holdout of quality.py.

Rows are the doc_id in the tables of scale 0.1, what the document is, its six statistics (STATS) and the judgement: 1 for lists, tables, forms and
junk, 0 for prose in any language. They were drawn by the number of statistics outside their range, so that doubtful ones are among them.
"""

HAND_CHECKED = [
    (1856, "judgment, English, names redacted", (147, 5.088, 0.03233, 16, 0.25, 0.449), 0),
    (2483, "judgment, English", (218, 4.583, 0.04183, 5, 0.4, 0.4633), 0),
    (4169, "judgment, English", (235, 4.668, 0.03551, 19, 0.2632, 0.4681), 0),
    (4526, "rules, exhibits and signature marks", (12, 4.083, 0.6774, 19, 0, 0.1667), 1),
    (4844, "form with boxes", (272, 4.783, 0.1512, 28, 0, 0.3971), 1),
    (5615, "table of costs", (436, 3.507, 0.1175, 50, 0, 0.211), 1),
    (5675, "table of costs", (356, 3.478, 0.1204, 42, 0, 0.2022), 1),
    (5681, "list of hearings", (113, 3.717, 0.06592, 13, 0, 0.0708), 1),
    (6155, "bullet list of terms", (69, 7.014, 0.06347, 31, 0.129, 0), 1),
    (9200, "lines of a heading", (14, 4.571, 0, 3, 0, 0.5714), 1),
    (9650, "list of hearings", (138, 3.739, 0.06422, 16, 0, 0.07246), 1),
    (10085, "judgment, English", (254, 4.709, 0.032, 20, 0.2, 0.4764), 0),
    (11024, "judgment, English", (194, 4.789, 0.02981, 20, 0.15, 0.4588), 0),
    (12863, "judgment, Polish", (360, 4.892, 0.0342, 10, 0.7, 0.005556), 0),
    (13706, "judgment, English", (594, 4.791, 0.09465, 15, 0.6, 0.4916), 0),
    (13757, "one running list of clauses with page numbers", (187, 3.754, 0.1029, 1, 0, 0.4332), 1),
    (13862, "form with boxes", (466, 4.745, 0.1485, 48, 0, 0.397), 1),
    (14060, "list of hearings", (100, 3.74, 0.06835, 12, 0, 0.04), 1),
    (14174, "judgment, English", (516, 4.634, 0.03232, 42, 0.1429, 0.4981), 0),
    (14252, "table of costs", (212, 3.486, 0.1186, 25, 0, 0.2075), 1),
    (14840, "form with boxes", (236, 4.593, 0.1426, 22, 0, 0.4237), 1),
    (15452, "judgment, English and French", (691, 4.651, 0.02687, 21, 0.4762, 0.508), 0),
    (16106, "one running list of clauses with page numbers", (394, 3.772, 0.09805, 1, 0, 0.4442), 1),
    (16475, "form with boxes", (122, 4.787, 0.1443, 12, 0, 0.4098), 1),
    (17006, "judgment, English", (839, 4.726, 0.03232, 65, 0.2769, 0.4839), 0),
    (18431, "judgment, English", (1326, 4.645, 0.03097, 21, 0.8571, 0.503), 0),
    (18554, "lines of an address", (16, 4.188, 0, 4, 0, 0.625), 1),
    (19226, "table of costs", (438, 3.546, 0.1163, 50, 0, 0.2146), 1),
    (21824, "table of costs", (116, 3.457, 0.1184, 14, 0, 0.2069), 1),
    (21869, "judgment, English, begins at paragraph 4", (270, 4.667, 0.0322, 7, 0.5714, 0.4407), 0),
    (22025, "judgment, English", (335, 4.573, 0.0387, 25, 0.24, 0.4776), 0),
    (23750, "judgment, English, cut off", (142, 4.444, 0.03238, 7, 0.2857, 0.4718), 0),
    (24629, "one running list of clauses with page numbers", (224, 3.643, 0.1012, 1, 0, 0.4598), 1),
    (25415, "list of hearings", (261, 3.72, 0.06842, 30, 0, 0.0613), 1),
    (26357, "form with boxes", (173, 4.59, 0.1504, 17, 0, 0.4162), 1),
    (26423, "judgment, German", (573, 5.019, 0.03241, 14, 0.6429, 0.4747), 0),
    (27068, "judgment, Polish", (187, 5.134, 0.03051, 7, 0.7143, 0.005348), 0),
    (27137, "judgment, English", (348, 4.759, 0.1694, 10, 0.8, 0.5086), 0),
    (27929, "table of filings", (310, 5.116, 0.05435, 52, 0, 0.003226), 1),
    (28013, "judgment, English, words redacted", (343, 4.668, 0.03416, 33, 0.1212, 0.5044), 0),
    (28079, "one word repeated", (53, 4.887, 0.006431, 1, 0, 0), 1),
    (28157, "judgment, English", (603, 4.617, 0.03253, 15, 0.6, 0.4959), 0),
    (28223, "judgment, English", (244, 5.074, 0.02368, 6, 0.5, 0.459), 0),
    (28784, "table of fees", (292, 3.185, 0.1679, 50, 0, 0), 1),
    (28949, "judgment, English", (329, 4.733, 0.02575, 25, 0.24, 0.4802), 0),
    (29102, "judgment, English", (200, 4.865, 0.0313, 20, 0.2, 0.455), 0),
    (29105, "judgment, French", (240, 3.925, 0.03868, 20, 0.35, 0.4792), 0),
    (29291, "judgment, German", (213, 5.366, 0.02647, 8, 0.75, 0.4178), 0),
    (29525, "judgment, Polish", (214, 4.967, 0.04114, 8, 0.625, 0.004673), 0),
    (29858, "string of citations only", (313, 3.182, 0.1863, 1, 0, 0.03514), 1),
]
