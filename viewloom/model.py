"""ViewDefinitions: the validated, immutable form of the JSON."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from .errors import ViewDefinitionError

# The resource types of FHIR R4, the two abstract ones included.
RESOURCE_TYPES = frozenset(
    """Account ActivityDefinition AdverseEvent AllergyIntolerance Appointment AppointmentResponse AuditEvent Basic Binary
    BiologicallyDerivedProduct BodyStructure Bundle CapabilityStatement CarePlan CareTeam CatalogEntry ChargeItem
    ChargeItemDefinition Claim ClaimResponse ClinicalImpression CodeSystem Communication CommunicationRequest
    CompartmentDefinition Composition ConceptMap Condition Consent Contract Coverage CoverageEligibilityRequest
    CoverageEligibilityResponse DetectedIssue Device DeviceDefinition DeviceMetric DeviceRequest DeviceUseStatement
    DiagnosticReport DocumentManifest DocumentReference DomainResource EffectEvidenceSynthesis Encounter Endpoint
    EnrollmentRequest EnrollmentResponse EpisodeOfCare EventDefinition Evidence EvidenceVariable ExampleScenario
    ExplanationOfBenefit FamilyMemberHistory Flag Goal GraphDefinition Group GuidanceResponse HealthcareService
    ImagingStudy Immunization ImmunizationEvaluation ImmunizationRecommendation ImplementationGuide InsurancePlan Invoice
    Library Linkage List Location Measure MeasureReport Media Medication MedicationAdministration MedicationDispense
    MedicationKnowledge MedicationRequest MedicationStatement MedicinalProduct MedicinalProductAuthorization
    MedicinalProductContraindication MedicinalProductIndication MedicinalProductIngredient MedicinalProductInteraction
    MedicinalProductManufactured MedicinalProductPackaged MedicinalProductPharmaceutical MedicinalProductUndesirableEffect
    MessageDefinition MessageHeader MolecularSequence NamingSystem NutritionOrder Observation ObservationDefinition
    OperationDefinition OperationOutcome Organization OrganizationAffiliation Parameters Patient PaymentNotice
    PaymentReconciliation Person PlanDefinition Practitioner PractitionerRole Procedure Provenance Questionnaire
    QuestionnaireResponse RelatedPerson RequestGroup ResearchDefinition ResearchElementDefinition ResearchStudy
    ResearchSubject Resource RiskAssessment RiskEvidenceSynthesis Schedule SearchParameter ServiceRequest Slot Specimen
    SpecimenDefinition StructureDefinition StructureMap Subscription Substance SubstanceNucleicAcid SubstancePolymer
    SubstanceProtein SubstanceReferenceInformation SubstanceSourceMaterial SubstanceSpecification SupplyDelivery
    SupplyRequest Task TerminologyCapabilities TestReport TestScript ValueSet VerificationResult VisionPrescription""".split()
)
# The value[x] of constants.
CONSTANT_TYPES = {
    "valueString": "string", "valueInteger": "integer", "valueDecimal": "decimal", "valueBoolean": "boolean", "valueDate": "date",
    "valueDateTime": "dateTime", "valueTime": "time", "valueInstant": "dateTime", "valueCode": "string", "valueId": "string", "valueUri": "string",
    "valueUrl": "string", "valueCanonical": "string", "valueUuid": "string", "valueOid": "string", "valueMarkdown": "string",
    "valueBase64Binary": "string", "valuePositiveInt": "integer", "valueUnsignedInt": "integer", "valueInteger64": "integer",
}
# Paths that are multi-valued in Patient, refused for a column that says it is no collection.
MULTI_VALUED = ("name.family", "name.given", "telecom.value", "address.line", "identifier.value", "extension.value")
_NAME = re.compile(r"[A-Za-z]\w*", re.ASCII)


@dataclass(frozen=True)
class Tag:
    name: str
    value: str


@dataclass(frozen=True)
class ColumnDef:
    name: str
    path: str
    type: str | None = None
    collection: bool | None = None
    description: str | None = None
    tags: tuple[Tag, ...] = ()


@dataclass(frozen=True)
class SelectNode:
    columns: tuple[ColumnDef, ...] = ()
    selects: tuple[SelectNode, ...] = ()
    union_all: tuple[SelectNode, ...] = ()
    for_each: str | None = None
    for_each_or_null: str | None = None
    repeat: tuple[str, ...] = ()

    def column_defs(self) -> list[ColumnDef]:
        """The columns in order of declaration: own, those of children, those of the first branch of the union."""
        out = list(self.columns)
        for s in self.selects:
            out += s.column_defs()
        if self.union_all:
            out += self.union_all[0].column_defs()
        return out


@dataclass(frozen=True)
class ConstantDef:
    name: str
    type: str
    value: object


@dataclass(frozen=True)
class ViewDefinition:
    resource: str
    selects: tuple[SelectNode, ...]
    where: tuple[str, ...] = ()
    constants: tuple[ConstantDef, ...] = ()
    status: str = "active"
    name: str | None = None

    def column_defs(self) -> list[ColumnDef]:
        return [c for s in self.selects for c in s.column_defs()]


def _text(value: object, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ViewDefinitionError(f"{what} must be a non-empty string")
    return value


def _items(value: object, what: str) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise ViewDefinitionError(f"{what} must be an array")
    for x in value:
        if not isinstance(x, Mapping):
            raise ViewDefinitionError(f"{what} must hold objects")
    return value


def _tag(raw: Mapping, column: str) -> Tag:
    return Tag(_text(raw.get("name"), f"tag name of column '{column}'"), _text(raw.get("value"), f"tag value of column '{column}'"))


def _column(raw: Mapping, iterates: bool) -> ColumnDef:
    name = raw.get("name")
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ViewDefinitionError(f"column name {name!r} must be a letter, then letters, digits or _")
    path = _text(raw.get("path"), f"path of column '{name}'")
    collection = raw.get("collection")
    if collection is not None and not isinstance(collection, bool):
        raise ViewDefinitionError(f"collection of column '{name}' must be true or false")
    if collection is False and not iterates and any(p in path for p in MULTI_VALUED):
        raise ViewDefinitionError(f"path '{path}' of column '{name}' can return several values: set collection to true, or use forEach")
    kind = raw.get("type")
    if kind is not None and not isinstance(kind, str):
        raise ViewDefinitionError(f"type of column '{name}' must be a string")
    tags = raw.get("tag")
    return ColumnDef(name, path, kind, collection, raw.get("description"), tuple(_tag(t, name) for t in _items(tags, f"tag of column '{name}'")))


def _select(raw: Mapping) -> SelectNode:
    if not any(raw.get(k) for k in ("column", "select", "unionAll")):
        raise ViewDefinitionError("a select must have column, select or unionAll")
    given = [k for k in ("forEach", "forEachOrNull", "repeat") if raw.get(k) not in (None, [])]
    if len(given) > 1:
        raise ViewDefinitionError(f"a select can have one of forEach, forEachOrNull and repeat, not {' and '.join(given)}")
    for k in ("forEach", "forEachOrNull"):
        if raw.get(k) is not None:
            _text(raw[k], k)
    repeat = raw.get("repeat") or []
    if not isinstance(repeat, list):
        raise ViewDefinitionError("repeat must be an array of paths")
    branches = tuple(_select(b) for b in _items(raw.get("unionAll"), "unionAll"))
    names = [[c.name for c in b.column_defs()] for b in branches]
    for other in names[1:]:
        if other != names[0]:
            raise ViewDefinitionError(f"the branches of unionAll must have the same columns in the same order: {names[0]} and {other}")
    return SelectNode(
        tuple(_column(c, bool(given)) for c in _items(raw.get("column"), "column")),
        tuple(_select(s) for s in _items(raw.get("select"), "select")),
        branches,
        raw.get("forEach"),
        raw.get("forEachOrNull"),
        tuple(_text(p, "a path of repeat") for p in repeat),
    )


def _constant(raw: Mapping) -> ConstantDef:
    name = raw.get("name")
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ViewDefinitionError(f"constant name {name!r} must be a letter, then letters, digits or _")
    given = [k for k in CONSTANT_TYPES if k in raw]
    if len(given) != 1:
        raise ViewDefinitionError(f"constant '{name}' must have exactly one value[x], not {len(given)}")
    value = raw[given[0]]
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise ViewDefinitionError(f"constant '{name}' must have a simple value")
    return ConstantDef(name, CONSTANT_TYPES[given[0]], value)


def parse_view(source: Mapping | str | os.PathLike) -> ViewDefinition:
    """A view from an object, from JSON text, or from the path of a JSON file; raises ViewDefinitionError."""
    if isinstance(source, os.PathLike) or (isinstance(source, str) and not source.lstrip().startswith(("{", "[", '"'))):
        with open(source, encoding="utf-8") as f:
            source = f.read()
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except json.JSONDecodeError as e:
            raise ViewDefinitionError(f"the view is not JSON: {e}") from e
    if not isinstance(source, Mapping):
        raise ViewDefinitionError("a view must be an object")
    if source.get("resourceType", "ViewDefinition") != "ViewDefinition":
        raise ViewDefinitionError(f"resourceType must be ViewDefinition, not {source['resourceType']!r}")
    resource = _text(source.get("resource"), "resource")
    if resource not in RESOURCE_TYPES:
        raise ViewDefinitionError(f"'{resource}' is no FHIR resource type")
    selects = _items(source.get("select"), "select")
    if not selects:
        raise ViewDefinitionError("a view must have at least one select")
    where = tuple(_text(w.get("path"), "path of where") for w in _items(source.get("where"), "where"))
    constants = tuple(_constant(c) for c in _items(source.get("constant"), "constant"))
    view = ViewDefinition(resource, tuple(map(_select, selects)), where, constants, source.get("status") or "active", source.get("name"))
    seen: dict[str, str] = {}
    for c in view.column_defs():
        if c.name.lower() in seen:
            raise ViewDefinitionError(f"column names '{seen[c.name.lower()]}' and '{c.name}' can't be told apart")
        seen[c.name.lower()] = c.name
    return view
