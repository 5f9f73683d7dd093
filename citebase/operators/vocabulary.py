"""Resolution of freely entered spec keys against the controlled vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citebase.functions.text import compact, deletions, one_edit
from citebase.session import small

#: Other names under which sources give a spec.
SPEC_ALIASES: dict[str, list[str]] = {
    "thickness_mm": ["dicke", "thk", "paneeldikte", "panel thickness", "épaisseur", "plaatdikte", "dikte paneel", "plattendicke"],
    "module_width_mm": ["panel width", "mod. width", "Modulbreite", "breedte module", "largeur de module", "paneelbreedte"],
    "module_length_mm": ["panel length", "mod. length", "Modullänge", "lengte module", "longueur de module", "paneellengte"],
    "suspension_depth_mm": ["plenum depth", "susp. depth", "ophanghoogte", "Abhängehöhe", "hauteur de suspension", "plenumhoogte"],
    "max_height_mm": ["max height", "max. hoogte", "maximale Höhe", "hauteur maximale", "max. Höhe"],
    "joint_width_mm": ["joint w.", "voeg", "Fugenbreite", "largeur de joint"],
    "weight_per_m2": ["weight m2", "areal weight", "oppervlaktegewicht", "Flächengewicht", "Flächenmasse", "masse surfacique"],
    "density": ["bulk density", "volumieke massa", "Rohdichte", "densité", "Dichte", "masse volumique"],
    "sound_attenuation_dnfw": ["Dnfw", "Dn,f,w", "ceiling attenuation", "plafonddemping"],
    "airborne_sound_reduction_rw": ["Rw", "R'w", "luchtgeluidisolatie", "Schalldämmmaß Rw", "Luftschalldämmung Rw"],
    "sound_absorption_alpha_w": ["alpha w", "αw", "a_w (absorptie)", "absorption αw"],
    "nrc": ["N.R.C.", "NRC-waarde", "noise reduction coeff.", "NRC-Zahl", "nrc value"],
    "light_reflectance": ["LR", "lichtreflectie LR", "light refl.", "Lichtreflexion", "réflexion lumineuse"],
    "max_relative_humidity": ["max. RH", "RV max", "luchtvochtigheid max", "max. Luftfeuchte", "humidité relative max"],
    "perforation_percentage": ["open area", "perf. pct", "perforatie %", "Lochanteil", "Perforation"],
    "recycled_content_pct": ["recycled share", "aandeel recyclaat", "Recyclinganteil", "Rezyklatmenge", "contenu recyclé"],
    "fire_resistance_ei": ["EI", "fire rating EI", "brandwerendheid", "Feuerwiderstand", "résistance au feu EI"],
    "max_service_temperature": ["max. service temp", "gebruikstemperatuur max", "Einsatztemperatur max.", "température maximale d'emploi"],
    "uniform_load": ["uniformly distributed load", "belasting gelijkmatig", "Flächenlast", "charge uniforme"],
    "wind_pressure": ["wind load", "winddruk max", "Windlast", "pression du vent"],
    "thermal_conductivity": ["lambda", "lambda value", "λ-waarde", "Wärmeleitfähigkeit", "conductivité thermique"],
    "thermal_resistance": ["Rd", "R-value", "R-waarde", "Wärmedurchlasswiderstand", "résistance thermique"],
    "gwp_a1a3": ["GWP", "GWP A1-A3", "global warming potential", "CO2-voetafdruk A1-A3"],
    "embodied_energy": ["embodied en.", "primaire energie", "graue Energie", "énergie grise"],
    "air_permeability": ["air leakage", "luchtlek", "Luftdurchlässigkeit", "perméabilité à l'air"],
    "formaldehyde_emission": ["formaldehyde", "HCHO emission", "HCHO-emissie", "Formaldehydabgabe", "émission de formaldéhyde"],
    "reaction_to_fire": ["fire class", "euroklasse", "reactie bij brand", "Brandverhalten", "réaction au feu"],
    "sound_absorption_class": ["abs. class", "absorptieklasse", "Schallabsorberklasse", "Schallabsorptionsklasse", "classe d'absorption"],
    "demountable": ["removable", "uitneembaar", "demontierbar", "démontable"],
    "ce_marked": ["CE mark", "CE-markering", "CE-Kennzeichnung", "marquage CE"],
    "edge_type": ["edge detail", "randafwerking", "Kantenform", "Kantenausführung", "type de bord"],
}

#: Shortest compact name for which one edit is forgiven.
TYPO_LENGTH = 5


def _bare(c):
    """Without a unit in brackets at the end."""
    return F.regexp_replace(c, r"\s*\([^()]*\)\s*:?\s*$", "")


def spec_names(spec_attributes: DataFrame) -> DataFrame:
    """(name, spec_key): every compact name under which an attribute is known; a name of two attributes is left out.

    Made once; the vocabulary is a controlled list, and a broadcast only behind a check of its length.
    """
    spark = spec_attributes.sparkSession
    alias = spark.createDataFrame([(k, a) for k, names in SPEC_ALIASES.items() for a in names], "spec_key string, alias string")
    own = spec_attributes.select("spec_key", F.explode(F.array("spec_key", "name_nl", "name_en")).alias("alias"))
    named = own.unionByName(alias.join(spec_attributes.select("spec_key"), "spec_key", "left_semi"))
    forms = named.select("spec_key", F.explode(F.array(compact("alias"), compact(_bare(F.col("alias"))))).alias("name")).where(F.length("name") > 0)
    return small(forms.groupBy("name").agg(F.min("spec_key").alias("spec_key"), F.max("spec_key").alias("other")).where("spec_key = other").drop("other"))


def spec_keys(spec_attributes: DataFrame) -> DataFrame:
    """(_entered, _k0): the keys as they stand, made once."""
    return small(spec_attributes.select(F.col("spec_key").alias("_entered"), F.col("spec_key").alias("_k0")).distinct())


def _keyed(rows: DataFrame, entered: str, known: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with ``_bare`` (the compact key without a bracketed unit) and ``_found``, by joins with the fixed list only."""
    a = names.select(F.col("name").alias("_whole"), F.col("spec_key").alias("_k1"))
    b = names.select(F.col("name").alias("_bare"), F.col("spec_key").alias("_k2"))
    # only keys that are no entry as they stand are brought to their compact form
    exact = rows.withColumn("_entered", F.col(entered)).join(known, "_entered", "left")
    other = lambda c: F.when(F.col("_k0").isNull(), compact(c))
    keyed = exact.withColumns({"_whole": other(F.col(entered)), "_bare": other(_bare(F.col(entered)))})
    first = keyed.join(a, "_whole", "left").join(b, "_bare", "left")
    return first.select(*rows.columns, "_bare", F.coalesce("_k0", "_k1", "_k2").alias("_found"))


def _typos(bare: DataFrame, names: DataFrame) -> DataFrame:
    """(_bare, _typo): compact keys one typing error away from the names of one attribute, blocked by shared deletion forms."""
    probes = bare.distinct().where(F.length("_bare") >= TYPO_LENGTH).select("_bare", F.explode(deletions(F.col("_bare"))).alias("form"))
    forms = names.where(F.length("name") >= TYPO_LENGTH).select("name", "spec_key", F.explode(deletions(F.col("name"))).alias("form"))
    near = probes.join(forms, "form").where(one_edit(F.col("_bare"), F.col("name")))
    return near.groupBy("_bare").agg(F.min("spec_key").alias("_typo"), F.max("spec_key").alias("_other")).where("_typo = _other").drop("_other")


def with_spec_key(rows: DataFrame, entered: str, spec_attributes: DataFrame, name: str = "resolved") -> DataFrame:
    """Rows whose entered key means an attribute, with that attribute's key; the others are left out.

    Spelled right, a key is found by joins with the fixed list, so busy keys are not shuffled. Typing errors are looked up
    over the distinct unknown spellings, a scan of the key alone; those that mean an attribute are a short list.
    """
    known, names = spec_keys(spec_attributes), spec_names(spec_attributes)
    unknown = _keyed(rows.select(entered).distinct(), entered, known, names).where("_found is null").select("_bare")
    typos = small(_typos(unknown, names))
    keyed = _keyed(rows, entered, known, names).withColumn("_bare", F.when(F.col("_found").isNull(), F.col("_bare")))
    return keyed.join(typos, "_bare", "left").withColumn(name, F.coalesce("_found", "_typo")).where(F.col(name).isNotNull()).select(*rows.columns, name)


def resolve_spec_keys(entered: DataFrame, spec_attributes: DataFrame) -> DataFrame:
    """(entered, spec_key) for every distinct entered key; spec_key is null where none is meant.

    ``entered`` has one string column ``entered``. Order: the key itself, its compact spelling, the compact spelling
    without a bracketed unit, then one typing error. Nulls give no row, empty keys resolve to null; a typing error that
    fits two attributes resolves to null.
    """
    known, names = spec_keys(spec_attributes), spec_names(spec_attributes)
    first = _keyed(entered.select("entered").where("entered is not null").distinct(), "entered", known, names)
    typo = _typos(first.where("_found is null").select("_bare"), names)
    return first.join(typo, "_bare", "left").select("entered", F.coalesce("_found", "_typo").alias("spec_key"))
