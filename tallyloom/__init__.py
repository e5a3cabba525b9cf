"""Usage metering and document integrity on PySpark.

The core holds the operators on usage logs, hierarchies, intervals and
document facts.  The subpackage ``llm`` holds operators for text corpora;
nothing outside of it imports it.
"""
