"""The eight invented cases of the synthetic fact base, as plain tables.

Everything in this module is a fixed value: the grid's scores are only comparable if it stays as it is.
"""

from __future__ import annotations

# case: focal entity
FOCAL = {
    "synth_case_001": "marta", "synth_case_002": "cafe", "synth_case_003": "committee", "synth_case_004": "ruth",
    "synth_case_005": "pavel", "synth_case_006": "synagogue", "synth_case_007": "heinrich", "synth_case_008": "suitcase",
}
# case, entity, type, name, fictional
ENTITIES = (
    ("synth_case_001", "marta", "person", "Marta Hellinger", True),
    ("synth_case_001", "adler", "org", "the Adler & Son hat workshop", True),
    ("synth_case_001", "josef", "person", "Josef Hellinger", True),
    ("synth_case_001", "rotterdam", "place", "Rotterdam", False),
    ("synth_case_002", "cafe", "place", "Café Landauer", True),
    ("synth_case_002", "hugo", "person", "Hugo Landauer", True),
    ("synth_case_003", "committee", "org", "the Brünn Emigration Aid Committee", True),
    ("synth_case_003", "office", "place", "Pekařská 12", True),
    ("synth_case_004", "ruth", "person", "Ruth Salzmann", True),
    ("synth_case_004", "hospital", "org", "the Jewish hospital on Ptašínského", True),
    ("synth_case_005", "pavel", "person", "Pavel Stern", True),
    ("synth_case_006", "synagogue", "place", "the Pferdgasse synagogue", True),
    ("synth_case_007", "heinrich", "person", "Heinrich Adler", True),
    ("synth_case_008", "suitcase", "object", "a brown leather suitcase", True),
    ("synth_case_008", "owner", "person", "Lena Kahn", True),
)
# case, entity, key, value; all are specific, attested, and grounded by S1
ATTRIBUTES = (
    ("synth_case_001", "marta", "occupation", "milliner"),
    ("synth_case_001", "marta", "birth_year", "1911"),
    ("synth_case_001", "adler", "address", "Brünnergasse 7, Brünn"),
    ("synth_case_002", "cafe", "address", "Krapfengasse 3, Brünn"),
    ("synth_case_002", "hugo", "role", "proprietor"),
    ("synth_case_003", "committee", "purpose", "assistance with emigration papers"),
    ("synth_case_004", "ruth", "occupation", "nurse"),
    ("synth_case_005", "pavel", "school", "the Hybešova primary school"),
    ("synth_case_005", "pavel", "birth_year", "1930"),
    ("synth_case_006", "synagogue", "built", "1885"),
    ("synth_case_007", "heinrich", "role", "owner of the Adler & Son hat workshop"),
    ("synth_case_008", "suitcase", "inventory_no", "WL-OBJ-0099"),
)
# case, event, type, summary, participant, its role, place, date, precision, certainty, source, salience, sensitivity
EVENTS = (
    ("synth_case_001", "E1", "employment", "Marta worked at the Adler & Son hat workshop", "marta", "employee", "adler", "1938", "year", "attested", "S1", 3, "low"),
    ("synth_case_001", "E2", "emigration", "Marta left for Rotterdam", "marta", "emigrant", "rotterdam", "1939", "year", "probable", "S2", 2, "low"),
    ("synth_case_001", "E3", "detention", "Marta was detained during a round-up", "marta", "detained", None, "1942", "year", "uncertain", "S2", 3, "high"),
    ("synth_case_002", "E1", "meeting_point", "Café Landauer served as an informal meeting point for emigration inquiries", "cafe", "venue", "cafe", "1938–1939", "range", "probable", "S1", 3, "low"),
    ("synth_case_002", "E2", "closure", "Café Landauer was closed and Aryanised", "cafe", "subject", "cafe", "1939", "year", "uncertain", "S2", 2, "medium"),
    ("synth_case_003", "E1", "operation", "the Committee helped families obtain emigration documents from its office on Pekařská", "committee", "actor", "office", "1939", "year", "attested", "S1", 3, "low"),
    ("synth_case_003", "E2", "dissolution", "the Committee ceased operating", "committee", "subject", None, "1941", "year", "probable", "S2", 2, "medium"),
    ("synth_case_004", "E1", "employment", "Ruth Salzmann nursed at the Jewish hospital on Ptašínského", "ruth", "employee", "hospital", "1940", "year", "attested", "S1", 3, "low"),
    ("synth_case_004", "E2", "transfer", "Ruth Salzmann was sent to Theresienstadt", "ruth", "deportee", None, "1942", "year", "probable", "S2", 3, "high"),
    ("synth_case_005", "E1", "schooling", "Pavel Stern was enrolled at the Hybešova primary school", "pavel", "pupil", None, "1938", "year", "attested", "S1", 3, "low"),
    ("synth_case_005", "E2", "exclusion", "Pavel Stern was removed from the school register", "pavel", "subject", None, "1940", "year", "probable", "S1", 2, "medium"),
    ("synth_case_006", "E1", "function", "the Pferdgasse synagogue served the city's eastern congregation", "synagogue", "venue", "synagogue", "1885–1938", "range", "attested", "S1", 3, "low"),
    ("synth_case_006", "E2", "destruction", "the Pferdgasse synagogue was damaged and later demolished", "synagogue", "subject", "synagogue", "1939", "year", "uncertain", "S2", 3, "high"),
    ("synth_case_007", "E1", "ownership", "Heinrich Adler ran the family hat workshop on Brünnergasse", "heinrich", "owner", None, "1925–1938", "range", "attested", "S1", 3, "low"),
    ("synth_case_007", "E2", "dispossession", "Heinrich Adler lost the workshop under forced transfer", "heinrich", "subject", None, "1939", "year", "probable", "S2", 3, "medium"),
    ("synth_case_008", "E1", "provenance", "the suitcase was donated to the archive as having belonged to Lena Kahn", "suitcase", "object", None, "1947", "year", "attested", "S1", 3, "low"),
    ("synth_case_008", "E2", "attribution", "Lena Kahn is thought to have carried it into emigration", "owner", "owner", None, "1939", "year", "uncertain", "S2", 2, "low"),
)
# case, head, type, tail, source, certainty, salience
RELATIONS = (
    ("synth_case_001", "josef", "sibling_of", "marta", "S2", "probable", 1),
    ("synth_case_002", "hugo", "proprietor_of", "cafe", "S1", "attested", 2),
)
# case, source, kind, archive reference, what it supports
SOURCES = (
    ("synth_case_001", "S1", "registry", "WL/SYN/118", ("marta.occupation", "marta.birth_year", "adler.address", "E1")),
    ("synth_case_001", "S2", "testimony", "WL/SYN/204", ("E2", "E3")),
    ("synth_case_002", "S1", "testimony", "WL/SYN/301", ("cafe.address", "hugo.role", "E1")),
    ("synth_case_002", "S2", "registry", "WL/SYN/302", ("E2",)),
    ("synth_case_003", "S1", "letter", "WL/SYN/410", ("committee.purpose", "E1")),
    ("synth_case_003", "S2", "registry", "WL/SYN/411", ("E2",)),
    ("synth_case_004", "S1", "registry", "WL/SYN/520", ("ruth.occupation", "E1")),
    ("synth_case_004", "S2", "testimony", "WL/SYN/521", ("E2",)),
    ("synth_case_005", "S1", "registry", "WL/SYN/630", ("pavel.school", "pavel.birth_year", "E1", "E2")),
    ("synth_case_006", "S1", "catalogue_entry", "WL/SYN/740", ("synagogue.built", "E1")),
    ("synth_case_006", "S2", "caption", "WL/SYN/741", ("E2",)),
    ("synth_case_007", "S1", "registry", "WL/SYN/118", ("heinrich.role", "E1")),
    ("synth_case_007", "S2", "letter", "WL/SYN/850", ("E2",)),
    ("synth_case_008", "S1", "catalogue_entry", "WL/SYN/960", ("suitcase.inventory_no", "E1")),
    ("synth_case_008", "S2", "testimony", "WL/SYN/961", ("E2",)),
)
# case, false text, sensational
FABRICATIONS = (
    ("synth_case_001", "After the Gestapo seized the Adler workshop she fled to Rotterdam in March 1939.", False),
    ("synth_case_001", "In 1942 she was dragged from her home at dawn and deported to the east.", True),
    ("synth_case_002", "It was firebombed by stormtroopers on 9 November 1938 with patrons still inside.", True),
    ("synth_case_003", "Its entire leadership was secretly executed in 1941 after a betrayal.", True),
    ("synth_case_004", "She personally smuggled forty children to safety before being shot at the gate.", True),
    ("synth_case_005", "He was the last child to leave the burning schoolhouse in 1940.", True),
    ("synth_case_006", "A mob burned it to the ground in a single night while the congregation was at prayer.", True),
    ("synth_case_007", "He confronted the new owner at gunpoint before vanishing without trace in 1939.", True),
    ("synth_case_008", "It still contained a child's shoe and a farewell letter when opened in 1947.", True),
)


def rows() -> list[tuple]:
    """One nested row for each case, as ``schemas.CASE`` has it."""
    mine = lambda table, case: [r[1:] for r in table if r[0] == case]
    out = []
    for case, focal in FOCAL.items():
        attributes = mine(ATTRIBUTES, case)
        entities = [(i, t, n, f, [(k, v, "specific", ["S1"], "attested") for e, k, v in attributes if e == i]) for i, t, n, f in mine(ENTITIES, case)]
        events = [(i, t, s, [(who, role)], place, (d, p, c), [src], sal, sens) for i, t, s, who, role, place, d, p, c, src, sal, sens in mine(EVENTS, case)]
        relations = [(h, t, x, [src], c, s) for h, t, x, src, c, s in mine(RELATIONS, case)]
        sources = [(i, k, ref, list(sup)) for i, k, ref, sup in mine(SOURCES, case)]
        out.append((case, focal, entities, events, relations, sources, mine(FABRICATIONS, case)))
    return out
