"""What a model's or an adapter's configuration says, whatever its shape: JSON as VARIANT, with rules for each value's type.

Configurations come from many sources, so a value may be missing, null or of
another type than meant; each such case has a fault of its own, and nothing of
a faulty configuration is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(config: Column, path: str) -> Column:
    """The type of a value as VARIANT names it; null where there is none, or it is null."""
    kind = F.schema_of_variant(F.variant_get(config, path, "variant"))
    return F.when(kind != "VOID", kind)


def text_of(config: Column, path: str) -> Column:
    """A string value; null for any other."""
    return F.when(kind_of(config, path) == "STRING", F.try_variant_get(config, path, "string"))


def flag_of(config: Column, *paths: str) -> Column:
    """``(value, valid)`` of the first of the paths with a value: false without any, not valid if it isn't boolean."""
    first = F.coalesce(*(F.when(kind_of(config, p).isNotNull(), F.struct(kind_of(config, p).alias("kind"), F.try_variant_get(config, p, "boolean").alias("value"))) for p in paths))
    return F.struct((first.isNotNull() & (first["kind"] == "BOOLEAN") & first["value"]).alias("value"), (first.isNull() | (first["kind"] == "BOOLEAN")).alias("valid"))


def model_format(text: Column, model_type: str, architecture: str) -> Column:
    """``(format, fault)`` of a model's configuration: dense, int8 or int4, or why it can't be used."""
    config = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(config).startswith("OBJECT"), F.lit(False))
    quantized = kind_of(config, "$.quantization_config")
    four, eight = (flag_of(config, f"$.quantization_config.load_in_{n}bit", f"$.quantization_config._load_in_{n}bit") for n in (4, 8))
    method = F.lower(F.coalesce(text_of(config, "$.quantization_config.quant_method"), F.lit("")))
    named = F.try_variant_get(config, "$.architectures", "array<string>")
    fault = (
        F.when(~is_object, "configuration is unreadable")
        .when(~F.coalesce(text_of(config, "$.model_type") == model_type, F.lit(False)), "another type of model")
        .when((F.size(named) > 0) & ~F.array_contains(named, architecture), "architecture is not declared")
        .when(quantized.isNotNull() & ~quantized.startswith("OBJECT"), "quantization is not valid")
        .when(quantized.isNotNull() & ~(four["valid"] & eight["valid"]), "load flags must be boolean")
        .when(quantized.isNotNull() & ((method != "bitsandbytes") | (four["value"] == eight["value"])), "quantization is not supported")
    )
    form = F.when(quantized.isNull(), "dense").when(four["value"], "int4").otherwise("int8")
    return F.struct(F.when(fault.isNull(), form).alias("format"), fault.alias("fault"))


def adapter_fault(text: Column, base_format: Column, base: Column, revision: Column) -> Column:
    """Why an adapter can't be used with a base model; null if it can.  ``revision`` is that of the base, null for a local one, which is not compared."""
    config = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(config).startswith("OBJECT"), F.lit(False))
    upper = lambda name: F.upper(F.coalesce(text_of(config, f"$.{name}"), F.lit("")))
    wanted = F.coalesce(text_of(config, "$.revision"), F.try_variant_get(config, "$.revision", "string"))
    return (
        F.when(~F.coalesce(base_format == "dense", F.lit(False)), "adapters need a dense base model")
        .when(~is_object, "configuration is unreadable")
        .when(upper("peft_type") != "LORA", "not a LoRA adapter")
        .when(upper("task_type") != "SEQ_2_SEQ_LM", "another task")
        .when(revision.isNotNull() & ~F.coalesce(text_of(config, "$.base_model_name_or_path") == base, F.lit(False)), "another base model")
        .when(revision.isNotNull() & wanted.isNotNull() & (wanted != revision), "another revision of the base model")
    )
