"""heapscope.sources"""
