"""Fixed schemas of the catalog, index and annotation tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in spec])


# Catalog column order and types.
CATALOG = _struct([
    ("image_path", _S), ("dataset_id", _S), ("sample_id", _S), ("group_id", _S),
    ("image_width", _I), ("image_height", _I), ("image_bytes", _L),
    ("tree_id", _S), ("cube_id", _S), ("face_id", _S), ("surface_type", _S), ("split", _S),
    ("has_ring", _B), ("has_pith", _B), ("has_defect_box", _B), ("has_defect_mask", _B),
    ("has_defect_class", _B), ("ring_annotation_path", _S), ("defect_annotation_path", _S),
    ("dataset_role", _S), ("source_split", _S), ("ring_label_state", _S),
    ("defect_label_state", _S), ("defect_instance_count", _I),
    ("ignored_defect_instance_count", _I), ("defect_mask_path", _S),
    ("pith_annotation_path", _S), ("ignore_mask_path", _S), ("raw_defect_classes", _S),
    ("unified_category", _S), ("defect_subtype", _S), ("attributes", _S),
    ("annotation_geometry", _S), ("supervision_scope", _S), ("auxiliary_task", _S),
    ("auxiliary_label", _S), ("auxiliary_annotation_path", _S), ("source_variant", _S),
    ("base_sample_id", _S), ("license_id", _S), ("ring_r2_fold", _S), ("notes", _S),
])

# Catalog columns that hold file references.
PATH_COLUMNS = [
    "image_path", "ring_annotation_path", "defect_annotation_path", "defect_mask_path",
    "pith_annotation_path", "ignore_mask_path", "auxiliary_annotation_path",
]

# Catalog defaults that are not empty.
CATALOG_DEFAULTS = {
    "ring_label_state": "missing",
    "defect_label_state": "missing",
    "supervision_scope": "primary",
}

# Column order of the written index files.
INDEX_COLUMNS = {
    "ring": [
        "sample_id", "dataset_id", "split", "source_annotation", "model_image_path",
        "skeleton_path", "boundary_path", "distance_path", "instance_path", "valid_path",
        "width", "height", "target_width", "target_height", "skeleton_pixels",
        "valid_pixels", "closed_ring_count", "instance_count", "non_nested_pairs",
        "status", "error",
    ],
    "crop": [
        "crop_path", "source_image", "source_dataset", "group_id", "split", "category",
        "subtype", "attributes", "source_class", "annotation_geometry", "bbox",
    ],
    "hash": ["sample_id", "image_path", "split", "group_id", "phash_hex", "hash_source"],
    "candidate": [
        "left_sample_id", "right_sample_id", "left_split", "right_split", "left_group_id",
        "right_group_id", "left_path", "right_path", "hamming_distance",
    ],
    "group": ["dataset_id", "group_id", "split", "ring_r2_fold", "sample_count"],
    "registry": [
        "dataset_id", "title", "status", "protocol_role", "unit_of_independence",
        "configured_path", "manifest_images", "physical_groups", "splits", "ring_images",
        "defect_labeled_images", "target_instances_manifest", "ignored_instances_manifest",
        "license_status",
    ],
    "mask_contract": [
        "sample_id", "split", "source_semantic_mask", "decoder", "unified_category_ids",
    ],
}

RLE = _struct([("size", T.ArrayType(_I)), ("counts", T.ArrayType(_I))])
IGNORE_REGION = _struct([
    ("bbox", T.ArrayType(_D)), ("segmentation", T.ArrayType(T.ArrayType(_D))),
    ("source_class", _S), ("reason", _S),
])
COCO_IMAGE = _struct([
    ("id", _L), ("file_name", _S), ("width", _I), ("height", _I), ("source_dataset", _S),
    ("group_id", _S), ("sample_id", _S), ("split", _S), ("defect_label_state", _S),
    ("ignored_instance_count", _I), ("ignore_bboxes", T.ArrayType(IGNORE_REGION)),
    ("source_semantic_mask", _S), ("unified_semantic_mask", _S),
])
COCO_ANNOTATION = _struct([
    ("id", _L), ("image_id", _L), ("category_id", _I), ("bbox", T.ArrayType(_D)), ("area", _D),
    ("iscrowd", _I), ("segmentation", _S), ("category", _S), ("subtype", _S),
    ("attributes", T.ArrayType(_S)), ("source_class", _S), ("instance_id", _S),
    ("geometry_type", _S), ("source_dataset", _S), ("group_id", _S),
])
COCO_CATEGORY = _struct([("id", _I), ("name", _S), ("supercategory", _S)])
COCO_DOCUMENT = _struct([
    ("images", T.ArrayType(COCO_IMAGE)), ("annotations", T.ArrayType(COCO_ANNOTATION)),
    ("categories", T.ArrayType(COCO_CATEGORY)),
])

SHAPE = _struct([
    ("label", _S), ("shape_type", _S), ("points", T.ArrayType(T.ArrayType(_D))),
])
SHAPE_FILE = _struct([
    ("shapes", T.ArrayType(SHAPE)), ("imagePath", _S), ("imageWidth", _I), ("imageHeight", _I),
])

VOC_ANNOTATION = _struct([
    ("size", _struct([("width", _D), ("height", _D)])),
    ("object", T.ArrayType(_struct([
        ("name", _S), ("truncated", _S),
        ("bndbox", _struct([("xmin", _D), ("ymin", _D), ("xmax", _D), ("ymax", _D)])),
    ]))),
])
CVAT_IMAGE = _struct([
    ("_name", _S), ("_width", _I), ("_height", _I),
    ("polyline", T.ArrayType(_struct([("_label", _S), ("_points", _S)]))),
])
