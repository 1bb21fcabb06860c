"""Dimension tables: predicates with salience, ontology, routing, roles. Fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Predicates that carry a salience weight; all others weigh nothing.
WEIGHTS = [
    ("agentic.capability.name", 3.0),
    ("agentic.capability.description", 3.0),
    ("code.doc.comment", 2.5),
    ("code.artifact.exported", 2.0),
    ("code.relationship.implements", 2.0),
    ("code.doc.signature", 1.5),
    ("code.artifact.test", -2.0),
    ("code.lineage.superseded-by", -2.0),
    ("entity.role.navigational", -2.0),
    ("entity.lifecycle.stale", -3.0),
]

# Class and parent class of the public upper ontology (BFO and CCO names).
SUBCLASS = [
    ("Continuant", "Entity"), ("Occurrent", "Entity"), ("GenericallyDependentContinuant", "Continuant"),
    ("IndependentContinuant", "Continuant"), ("MaterialEntity", "IndependentContinuant"), ("Object", "MaterialEntity"),
    ("Process", "Occurrent"), ("InformationContentEntity", "GenericallyDependentContinuant"),
    ("DirectiveInformationContentEntity", "InformationContentEntity"),
    ("DescriptiveInformationContentEntity", "InformationContentEntity"),
    ("DesignativeInformationContentEntity", "InformationContentEntity"),
    ("Specification", "DirectiveInformationContentEntity"), ("Requirement", "DirectiveInformationContentEntity"),
    ("PlanSpecification", "DirectiveInformationContentEntity"), ("Rule", "DirectiveInformationContentEntity"),
    ("Objective", "DirectiveInformationContentEntity"), ("SoftwareCode", "DirectiveInformationContentEntity"),
    ("Algorithm", "DirectiveInformationContentEntity"), ("Identifier", "DesignativeInformationContentEntity"),
    ("Name", "DesignativeInformationContentEntity"),
    ("MeasurementInformationContentEntity", "DescriptiveInformationContentEntity"), ("Artifact", "Object"),
    ("InformationBearingArtifact", "Artifact"), ("Document", "InformationBearingArtifact"), ("Agent", "Object"),
    ("Person", "Agent"), ("Organization", "Agent"), ("Act", "Process"),
]

# Domain (null: any language), kind and class.
CLASS_OF = [
    ("git", "commit", "Act"), ("git", "author", "Person"), ("git", "branch", "DesignativeInformationContentEntity"),
    ("web", "page", "Document"), ("web", "doc", "Document"), ("config", "gomod", "Specification"),
    ("config", "project", "Specification"), ("config", "package", "Specification"),
    ("config", "dependency", "DesignativeInformationContentEntity"), ("config", "image", "Identifier"),
    ("media", "image", "InformationBearingArtifact"), ("media", "video", "InformationBearingArtifact"),
    ("media", "audio", "InformationBearingArtifact"), ("media", "keyframe", "InformationBearingArtifact"),
    ("media", "blob", "InformationBearingArtifact"), (None, "function", "Algorithm"), (None, "method", "Algorithm"),
    (None, "struct", "SoftwareCode"), (None, "interface", "SoftwareCode"), (None, "class", "SoftwareCode"),
    (None, "enum", "SoftwareCode"), (None, "type", "SoftwareCode"), (None, "const", "SoftwareCode"),
    (None, "var", "SoftwareCode"), (None, "component", "SoftwareCode"), (None, "package", "SoftwareCode"),
    (None, "file", "InformationBearingArtifact"), (None, "folder", "InformationBearingArtifact"), (None, "repo", "Artifact"),
]

# Extension to language; the contested header extension goes to C++ first.
ROUTES = [
    (".go", "golang"), (".py", "python"), (".java", "java"), (".ts", "typescript"), (".tsx", "typescript"),
    (".mts", "typescript"), (".cts", "typescript"), (".js", "javascript"), (".jsx", "javascript"), (".mjs", "javascript"),
    (".cjs", "javascript"), (".svelte", "svelte"), (".c", "c"), (".cpp", "cpp"), (".cc", "cpp"), (".cxx", "cpp"),
    (".hpp", "cpp"), (".hh", "cpp"), (".hxx", "cpp"), (".h", "cpp"),
]

CODE_DOMAINS = ("golang", "python", "typescript", "javascript", "java", "svelte", "c", "cpp")
IMPACT = ("code.relationship.calls", "code.relationship.extends", "code.relationship.implements", "code.relationship.references", "code.relationship.embeds")

# Predicate, role seen from its subject, role seen from its object.
EDGE_ROLES = [
    ("code.relationship.calls", "callee", "caller"),
    ("code.structure.contains", "contains", "container"),
    ("code.relationship.extends", "extends", "extended_by"),
    ("code.relationship.implements", "implements", "implemented_by"),
    ("code.relationship.references", "references", "referenced_by"),
    ("code.relationship.embeds", "embeds", "embedded_by"),
    ("code.structure.belongs", "parent_document", "passage"),
]


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "predicate string, weight double")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBCLASS, "class string, parent string")


def class_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASS_OF, "domain string, kind string, class string")


def closure(up: dict[str, str] | None = None) -> list[tuple[str, str, int]]:
    """(class, ancestor or itself, steps up) of the whole ontology: a few hundred rows, fixed."""
    up = dict(SUBCLASS) if up is None else up
    out = []
    for c in sorted({*up, *up.values()}):
        at, steps, seen = c, 0, set()
        while at is not None and at not in seen:
            out.append((c, at, steps))
            seen.add(at)
            at, steps = up.get(at), steps + 1
    return out
