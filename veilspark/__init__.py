"""veilspark: find, mask and restore sensitive text with Spark DataFrames."""

from veilspark.functions.rulepack import CustomRule, RulePack
from veilspark.operators.detect import detect
from veilspark.operators.mask import mask
from veilspark.operators.restore import restore, restore_from_vault

__all__ = ["CustomRule", "RulePack", "detect", "mask", "restore", "restore_from_vault"]
