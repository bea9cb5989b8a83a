"""girder: inspection-record analytics and training-data operators on Spark."""
