"""Tables and word lists that results depend on, in their natural order."""

from __future__ import annotations

# Leading cases that are cited by name alone (name, aliases, case number).
FREQUENT_CASES = [
    ("Van Gend en Loos v Nederlandse Administratie der Belastingen", ["Van Gend en Loos", "Van Gend"], "C-26/62"),
    ("Costa v ENEL", ["Costa v ENEL", "Costa"], "C-6/64"),
    ("Rewe-Zentral v Bundesmonopolverwaltung für Branntwein", ["Cassis de Dijon", "Rewe-Zentral"], "C-120/78"),
    ("Amministrazione delle Finanze dello Stato v Simmenthal", ["Simmenthal"], "C-106/77"),
    ("Marleasing v La Comercial Internacional de Alimentación", ["Marleasing"], "C-106/89"),
    ("Francovich and Bonifaci v Italy", ["Francovich"], "C-6/90"),
    ("Criminal proceedings against Keck and Mithouard", ["Keck", "Keck and Mithouard"], "C-267/91"),
    ("Union royale belge des sociétés de football association v Bosman", ["Bosman"], "C-415/93"),
    ("Kadi and Al Barakaat International Foundation v Council and Commission", ["Kadi", "Kadi I"], "C-402/05 P"),
    ("Akzo Nobel Chemicals and Akcros Chemicals v Commission", ["Akzo Nobel", "Akzo"], "C-550/07 P"),
    ("Akzo Nobel and Others v Commission", ["Akzo Nobel", "Akzo"], "C-97/08 P"),
    ("Åkerberg Fransson", ["Åkerberg Fransson", "Akerberg Fransson", "Fransson"], "C-617/10"),
    ("Google Spain and Google v Agencia Española de Protección de Datos and Costeja González", ["Google Spain", "Costeja"], "C-131/12"),
    ("Digital Rights Ireland and Seitlinger and Others", ["Digital Rights Ireland", "Digital Rights"], "C-293/12"),
    ("Intel v Commission", ["Intel"], "T-286/09"),
    ("Intel v Commission", ["Intel"], "C-413/14 P"),
    ("Taricco and Others", ["Taricco"], "C-105/14"),
    ("Schrems v Data Protection Commissioner", ["Schrems", "Schrems I"], "C-362/14"),
    ("Slowakische Republik v Achmea", ["Achmea"], "C-284/16"),
    ("Data Protection Commissioner v Facebook Ireland and Schrems", ["Schrems", "Schrems II"], "C-311/18"),
]

# Parties of so many cases that their names shorten none.
GENERIC_PARTIES = {
    "commission", "european commission", "commission of the european communities", "ec",
    "council", "council of the european union", "european council", "parliament", "european parliament",
    "court", "court of justice", "court of auditors", "ecb", "european central bank", "eu", "european union",
    "others", "and others", "e.a.", "ea", "member states", "member state",
    "austria", "belgium", "bulgaria", "croatia", "cyprus", "czech republic", "denmark", "estonia",
    "finland", "france", "germany", "greece", "hungary", "ireland", "italy", "latvia", "lithuania",
    "luxembourg", "malta", "netherlands", "poland", "portugal", "romania", "slovakia", "slovenia",
    "spain", "sweden", "united kingdom",
}

# Words that begin many companies' names and alone name none.
WEAK_LEADS = {
    "digital", "european", "national", "international", "general", "federal", "royal", "united",
    "new", "data", "open", "smart", "global", "first", "air", "post", "bank", "group", "union",
    "central", "north", "south", "east", "west", "deutsche", "nederlandse", "société", "sociedad",
}

# Legal forms at the end of a party's name, dots left out.
LEGAL_FORMS = {"ea", "ltd", "limited", "gmbh", "ag", "sa", "nv", "bv", "spa", "plc", "inc", "corp", "corporation", "sarl", "sas", "oy", "ab", "aps", "kft", "se", "llc", "kg", "co"}


def frequent_names() -> dict[str, list[str]]:
    """Case numbers by each name and alias in lower case."""
    out: dict[str, list[str]] = {}
    for name, aliases, number in FREQUENT_CASES:
        for key in dict.fromkeys(x.lower() for x in (name, *aliases)):
            out.setdefault(key, []).append(number)
    return out
