"""retailscope: sales-intelligence jobs for a retail star schema, as Spark DataFrame operators."""
