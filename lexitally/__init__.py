"""Term ranking over product text, expressed as Spark DataFrame operators."""
