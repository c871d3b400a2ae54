"""Fixed values of the domain: elements, aliases, classes, units, families."""

from __future__ import annotations

# Element, atomic number, oxidation state, ionic radius (pm, CN 8), lanthanide flag.
ELEMENTS = (
    ("Calcium", 20, 2, 112.0, 0),
    ("Scandium", 21, 3, 87.0, 0),
    ("Yttrium", 39, 3, 101.9, 0),
    ("Lanthanum", 57, 3, 116.0, 1),
    ("Cerium", 58, 3, 114.3, 1),
    ("Praseodymium", 59, 3, 112.6, 1),
    ("Neodymium", 60, 3, 110.9, 1),
    ("Samarium", 62, 3, 107.9, 1),
    ("Europium", 63, 3, 106.6, 1),
    ("Gadolinium", 64, 3, 105.3, 1),
    ("Terbium", 65, 3, 104.0, 1),
    ("Dysprosium", 66, 3, 102.7, 1),
    ("Holmium", 67, 3, 101.5, 1),
    ("Erbium", 68, 3, 100.4, 1),
    ("Thulium", 69, 3, 99.4, 1),
    ("Ytterbium", 70, 3, 98.5, 1),
    ("Lutetium", 71, 3, 97.7, 1),
)
# Spellings of the splits, lower-case letters only.
SPLITS = {"train": ("train", "training", "trn"), "validation": ("validation", "val", "valid", "dev", "development"), "test": ("test", "testing", "holdout", "heldout", "tst")}
# Sources that the strict tier leaves out, as they comment on the measurements of others.
EXCLUDED_PAPERS = ("nature_d41586-023-01739",)
ELEMENT_COLUMNS = ("element", "atomic_number", "oxidation_state", "ionic_radius_pm", "is_lanthanide")

# Symbols of the trivalent elements, in the order in which predictions are listed, then scandium.
TRIVALENT = {
    "La": "Lanthanum", "Ce": "Cerium", "Pr": "Praseodymium", "Nd": "Neodymium", "Sm": "Samarium", "Eu": "Europium",
    "Gd": "Gadolinium", "Tb": "Terbium", "Dy": "Dysprosium", "Ho": "Holmium", "Er": "Erbium", "Tm": "Thulium",
    "Yb": "Ytterbium", "Lu": "Lutetium", "Y": "Yttrium", "Sc": "Scandium",
}
PREDICTED = tuple(n for s, n in TRIVALENT.items() if s != "Sc")
#: Order of the measured columns of the screening sheet.
SCREENED = ("Y", *(s for s in TRIVALENT if s not in ("Y", "Sc")))

# Spellings of the other elements.
OTHER_SPELLINGS = {
    "Calcium": ("ca", "ca2+", "caii", "ca(ii)", "ca²⁺"),
    "Uranium": ("u", "uvi", "u(vi)", "uo2"),
    "Plutonium": ("pu", "puiv"),
    "Americium": ("am", "amiii", "am(iii)"),
    "Curium": ("cm", "cmiii", "cm(iii)"),
    "Thorium": ("th", "thiv"),
}

# Labels of groups of elements, which name no element.
ELEMENT_GROUPS = ("light rees", "heavy rees", "lres", "hres", "rare earths", "lanthanides", "actinides", "rare earth elements", "rees")


def element_spellings() -> dict[str, str]:
    """Lower-case spelling to element name: full names, symbols and the usual forms of the ion."""
    out = {}
    for symbol, name in TRIVALENT.items():
        s = symbol.lower()
        for spelled in (name.lower(), s, f"{s}3+", f"{s}iii", f"{s}(iii)", f"{s}³⁺"):
            out[spelled] = name
    for name, spelled in OTHER_SPELLINGS.items():
        out |= dict.fromkeys((name.lower(), *spelled), name)
    return out


# Names of one protein that stand for a screened ortholog.
CANONICAL_ALIASES = {"Mex-LanM": "o-621", "WT-LanM": "o-621", "WT": "o-621", "Hans-LanM": "o-180", "Melba-LanM": "o-36"}
BARE_MUTATIONS = {"R100K": "Hans-LanM(R100K)"}
DROPPED_NAMES = ("LanM",)
ORGANISM_PREFIXES = ("mex", "hans", "melba")
SUFFIX_TAGS = ("-Cys", "-GSGC", "(GSGC)", "-SpyTag3", "-SpyTag", "-His6", "-His10")

# Construct type, scaffold and the names that have them.
CONSTRUCTS = (
    ("point_mutant", "Lanmodulin", ("4D9A", "4D9H", "4D9M", "4D9N", "4P2A", "Hans-LanM(R100K)")),
    ("fusion_sensor", "Lanmodulin+GFP", ("LanTERN", "LanM-GCaMP")),
    ("engineered_chelator", "Lanmodulin", ("LanND-Gd", "ProCA32", "EF1", "EF2", "EF3", "EF4")),
    ("engineered_chelator", "Calmodulin", ("CaBM",)),
    ("engineered_chelator", "unknown", ("RF1", "RF2", "RF2 6AW", "RF3")),
    ("ortholog", "lanpepsy", ("MIF",)),
    ("engineered_chelator", "de_novo", ("LBT",)),
    ("ortholog", "non_LanM_protein", ("wild-type S. oneidensis",)),
    ("ortholog", "unknown", ("CDS J19_31570",)),
)
CONSTRUCT_TYPES = ("ortholog", "point_mutant", "fusion_sensor", "chimera", "engineered_chelator", "unknown")

# Measurement families and their value types, in lower case.
FAMILIES = {
    "binding_affinity": ("kd", "kd_app", "kd1"),
    "dimerization_affinity": ("kdimer", "kd_dimer"),
    "response_threshold": ("ec50",),
    "distribution": ("logd", "normalized_logd"),
    "thermodynamics": ("δgapp",),
    "relaxivity": ("r₁", "r1", "relaxivity"),
    "binding_capacity": ("binding",),
    "process_metric": ("fold difference", "fold_change", "purity", "yield", "separation"),
}
MOLAR_SCALES = {"m": 1.0, "um": 1e-6, "μm": 1e-6, "µm": 1e-6, "nm": 1e-9, "pm": 1e-12, "fm": 1e-15}
