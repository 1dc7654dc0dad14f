"""Declared schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One row for each report, drug and reaction; the order of columns is part of the contract.
FACT = struct(
    safetyreportid=S, receivedate=S, receive_year=I, receive_quarter=S, serious=S, outcome_death=S, outcome_lifethreat=S,
    outcome_hosp=S, outcome_disab=S, reporter_country=S, reporter_qual=S, age_years=D, age_stratum=S, sex=S, drug_name=S,
    drug_name_source=S, drug_characterization=S, drug_indication=S, reaction_pt=S,
)

#: What a fact says of a drug of its report.
OF_DRUG = [f for f in FACT.fieldNames() if f.startswith(("outcome_", "drug_"))]
#: One row for each report, its drugs and its reactions as lists: the facts are their product.
PACKED = T.StructType([f for f in FACT.fields if f.name not in (*OF_DRUG, "reaction_pt")] + [
    T.StructField("drugs", T.ArrayType(T.StructType([f for f in FACT.fields if f.name in OF_DRUG]))), T.StructField("reactions", T.ArrayType(S)),
])

# Names in the regulator's product section come as one string or as a list: read as text, opened in flatten().
OPENFDA = struct(generic_name=S, brand_name=S, substance_name=S)
DRUG = struct(activesubstance=struct(activesubstancename=S), medicinalproduct=S, openfda=OPENFDA, drugcharacterization=S, drugindication=S)
REACTION = struct(reactionmeddrapt=S)
#: A raw report. ``drug`` and ``reaction`` may be one object or a list, so they too are read as text first.
REPORT = struct(
    safetyreportid=S, receivedate=S, receiptdate=S, serious=S, seriousnessdeath=S, seriousnesslifethreatening=S,
    seriousnesshospitalization=S, seriousnessdisabling=S, primarysource=struct(reportercountry=S, qualification=S),
    patient=struct(patientonsetage=S, patientonsetageunit=S, patientsex=S, drug=S, reaction=S),
)
RAW_FILE = struct(results=T.ArrayType(REPORT))
CONTINGENCY = struct(drug=S, pt=S, a=L, b=L, c=L, d=L, n=L)
MANIFEST = struct(file=S, size_mb=S, records=L)
APPROVAL = struct(drug_name=S, results=T.ArrayType(struct(submissions=T.ArrayType(struct(submission_type=S, submission_status=S, submission_status_date=S)))))
# The sections of a label that speak of safety.
SAFETY_SECTIONS = [
    "adverse_reactions", "warnings", "warnings_and_cautions", "boxed_warning",
    "precautions", "contraindications", "drug_interactions", "use_in_specific_populations",
]
